"""What the jobs share: configuration files and folders of their own."""

from __future__ import annotations

import json
import pathlib
import uuid
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import SparkSession

from passagelake.sources import files

C = TypeVar("C")


def configured(spark: SparkSession, kind: type[C], path: str | None) -> C:
    """A configuration from a JSON object, read through Spark so that its path may be remote;
    the defaults where there is none. Names that the job does not know are an error."""
    if not path:
        return kind()
    found = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    unknown = sorted(set(found) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"{path}: unknown settings {', '.join(unknown)}")
    return kind(**found)


def beside(module: str, name: str) -> str:
    """The address of the configuration file that lies beside a job."""
    return (pathlib.Path(module).resolve().parent / name).as_uri()


def own_folder(spark: SparkSession, job: str) -> str:
    """A folder that no other run has, in the shared one; it stays when the driver ends."""
    return f"{files.shared_folder(spark)}/jobs/{job}-{uuid.uuid4().hex}"
