"""A wiki behind ``fake:FOLDER``: pages from FOLDER/wiki.json, one file per request in
FOLDER/calls. After ``dies_after`` answered requests it stays silent until FOLDER/alive exists."""

import json
import pathlib
import urllib.parse
import uuid


def set_up(folder, pages, per_list=3, dies_after=None, refuses=()):
    (folder / "calls").mkdir(parents=True)
    (folder / "wiki.json").write_text(json.dumps({"pages": pages, "per_list": per_list, "dies_after": dies_after, "refuses": list(refuses)}))
    return f"fake:{folder}"


def calls(folder):
    return sorted(p.read_text() for p in (folder / "calls").iterdir())


def transport(url, timeout):
    address, _, query = url.partition("?")
    folder = pathlib.Path(address.removeprefix("fake:"))
    wiki, asked = json.loads((folder / "wiki.json").read_text()), dict(urllib.parse.parse_qsl(query))
    if wiki["dies_after"] is not None and len(calls(folder)) >= wiki["dies_after"] and not (folder / "alive").exists():
        raise OSError("no route")
    if asked["action"] == "query":
        titles = sorted(t for t in wiki["pages"] if t.startswith(asked["apprefix"]))
        at = titles.index(asked["apcontinue"]) if "apcontinue" in asked else 0
        part, rest = titles[at : at + wiki["per_list"]], titles[at + wiki["per_list"] :]
        answer = {"query": {"allpages": [{"title": t} for t in part]}} | ({"continue": {"apcontinue": rest[0], "continue": "-||"}} if rest else {})
        said = f"list {at}"
    else:
        title, said = asked["page"], f"page {asked['page']}"
        answer = {"error": {"code": "missingtitle"}} if title in wiki["refuses"] else {"parse": {"title": title, "text": wiki["pages"][title]}}
    (folder / "calls" / uuid.uuid4().hex).write_text(said)
    return 200, {}, json.dumps(answer).encode()
