"""Small results as files: whole or not at all, the same bytes for the same content, and only where they may be."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame


def contained(path: str | Path, root: str | Path, inputs: list[str | Path] = (), fresh: bool = False) -> Path:
    """The resolved path, if it lies under ``root``, is no input and, with ``fresh``, does not exist yet."""
    target = Path(path).resolve()
    if not target.is_relative_to(Path(root).resolve()):
        raise ValueError("output_outside_root")
    if target in {Path(x).resolve() for x in inputs}:
        raise ValueError("output_overwrites_input")
    if fresh and target.exists():
        raise ValueError("output_exists")
    return target


def write_text(path: str | Path, text: str) -> None:
    """UTF-8 with line feeds, under another name until it is whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def to_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n"


def write_json(path: str | Path, value: object) -> None:
    write_text(path, to_json(value))


def write_table(df: DataFrame, path: str, kind: str = "parquet", overwrite: bool = False) -> None:
    """A table of any size, by Spark's commit protocol; refuses to replace one unless told to."""
    df.write.mode("overwrite" if overwrite else "errorifexists").format(kind).save(path)


def schemas(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Columns and types by table, to be kept as a snapshot."""
    return {name: [f"{c} {t}" for c, t in df.dtypes] for name, df in sorted(tables.items())}


def stale(tables: dict[str, DataFrame], snapshot: str | Path) -> list[str]:
    """The tables whose schema is not the one of a snapshot that ``write_json`` wrote."""
    known = json.loads(Path(snapshot).read_text(encoding="utf-8")) if Path(snapshot).exists() else {}
    now = schemas(tables)
    return sorted(n for n in known.keys() | now.keys() if known.get(n) != now.get(n))
