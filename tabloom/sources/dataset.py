"""Question sets and column descriptions in JSON."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession


def load_dataset(folder: str) -> list[dict]:
    """The tables of a folder with their questions, by file name.

    A file is a list of questions, with the table in a ``.md`` file of that name, or an
    object of ``questions`` with ``markdown``, ``markdown_path`` or ``csv_path``. Each
    entry has table_id, questions, and markdown or csv_path.
    """
    out = []
    for name in sorted(x for x in os.listdir(folder) if x.endswith(".json")):
        base = name[:-5]
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            d = json.load(f)
        entry: dict = {"table_id": base}
        if isinstance(d, list):
            entry |= {"questions": [question(x, i) for i, x in enumerate(d)], "markdown": _read(os.path.join(folder, base + ".md"))}
        else:
            entry |= {"table_id": str(d.get("table_id", base)), "questions": [question(x, i) for i, x in enumerate(d.get("questions") or [])]}
            if d.get("markdown"):
                entry["markdown"] = d["markdown"]
            elif d.get("markdown_path"):
                entry["markdown"] = _read(os.path.join(folder, d["markdown_path"]))
            elif d.get("csv_path"):
                entry["csv_path"] = os.path.join(folder, d["csv_path"])
        if entry.get("markdown") or entry.get("csv_path"):
            out.append(entry)
    return out


def question(d: dict, i: int = 0) -> dict:
    """qid, text and ground_truth of a question, whatever its keys are called."""
    truth = next((d[k] for k in ("ground_truth", "answers", "answer", "targets") if d.get(k) is not None), [])
    return {"qid": str(d.get("qid", d.get("id", f"q{i + 1}"))), "text": d.get("text", d.get("question", "")), "ground_truth": [str(x) for x in (truth if isinstance(truth, list) else [truth])]}


def _read(path: str) -> str | None:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return f.read()


def load_metadata(path: str) -> dict[str, dict]:
    """Column descriptions by table id, from an object, an array of objects, or one object a line."""
    content = _read(path) or ""
    try:
        d = json.loads(content)
    except ValueError:
        d = [json.loads(x) for x in content.splitlines() if x.strip()]
    if isinstance(d, dict) and "table_id" not in d:
        return d
    return {str(x.get("table_id", x.get("id", i))): x for i, x in enumerate(d if isinstance(d, list) else [d])}


def metadata_of(metadata: dict[str, dict], table_id: str) -> dict | None:
    """The entry of that id, else the first whose id holds it or is held by it."""
    return metadata.get(table_id) or next((v for k, v in metadata.items() if table_id in k or k in table_id), None)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions in JSON lines: table_id, qid, text, ground_truth."""
    return spark.read.schema("table_id string, qid string, text string, ground_truth array<string>").json(path)
