"""Runnable jobs over the tables: each is a function that takes a session, a command line
(``python -m jobs.<name> --help``) and a small configuration file beside it."""
