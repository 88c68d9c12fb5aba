"""The code index from sources: functions, structs and global variables by a tagger's entries, calls and references by the
functions' own tokens.

Entries are grouped by their file and meet its text once; an Arrow function cuts the definitions out by their lines, and reads
each function's body once for its calls and for the globals that it names. What it finds is one written table of rows of all
kinds, so texts are read once however many tables are made from it. Names are resolved by joins: a call by the one function of
its name or short name, a reference by the file's own static variable, else a visible one. Work grows with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.c_code import blanked, calls_of, closing, tokens, uses_of
from ..functions.text import access_type, normal_path, qualified_name, return_type, short_name
from .lookup import resolve_calls, resolve_globals

#: A tagger's kinds.
FUNCTIONS = ("function", "func", "f", "method")
STRUCTS = ("struct", "class", "union", "s", "c", "u")
TYPEDEFS = ("typedef", "t")
VARIABLES = ("variable", "externvar", "var", "v", "x")
#: Names of global variables whose uses are indexed begin like this.
GLOBAL = "g_"

PARTS = "part string, path string, owner_line long, name string, signature string, return_type string, start_line long, end_line long, is_static boolean, is_extern boolean, body string, column_at long"
_PARTS = pa.schema([("part", pa.string()), ("path", pa.string()), ("owner_line", pa.int64()), ("name", pa.string()), ("signature", pa.string()), ("return_type", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("is_static", pa.bool_()), ("is_extern", pa.bool_()), ("body", pa.string()), ("column_at", pa.int64())])
ENTRY = ("name", "kind", "line", "end", "signature", "return_type", "typeref", "file_scope")


def block_end(lines: list[str], start: int) -> int:
    """The line of the brace that closes the first block from this line on; the line itself if none does."""
    depth, opened = 0, False
    for n in range(start - 1, len(lines)):
        for c in lines[n]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return n + 1
    return start


def definition_end(lines: list[str], start: int) -> int:
    """The end of a block, else the first line with a semicolon, else the line itself."""
    end = block_end(lines, start)
    return end if end != start else statement_end(lines, start)


def statement_end(lines: list[str], start: int) -> int:
    return next((n + 1 for n in range(start - 1, len(lines)) if ";" in lines[n]), start)


def parts_of(path: str, text: str, entries: list[dict]) -> Iterator[tuple]:
    """Rows of PARTS of one file."""
    lines = text.split("\n")
    for e in sorted(entries, key=lambda e: (e["line"] or 0, e["name"] or "")):
        kind, start, name = (e["kind"] or "").lower(), e["line"] or 0, e["name"]
        if start <= 0 or not name:
            continue
        end_of = block_end if kind in FUNCTIONS else statement_end if kind in VARIABLES else definition_end
        end = e["end"] if (e["end"] or 0) >= start else end_of(lines, start)
        body = "\n".join(lines[start - 1 : max(end, start)])
        head = body.split("\n", 1)[0]
        static = bool(e["file_scope"]) or head.lstrip().startswith("static ")
        if kind in FUNCTIONS:
            if "{" not in body:
                continue
            yield ("function", path, start, name, e["signature"] or head.strip(), e["return_type"], start, end, static, False, body, None)
            tok, at, columns = tokens(blanked(body))
            for i, callee in calls_of(tok, closing(tok)):
                yield ("call", path, start, callee, name, None, start + at[i], None, None, None, None, columns[i])
            for i, used in uses_of(tok, at, GLOBAL):
                shown = lines[start + at[i] - 1] if start + at[i] <= len(lines) else ""
                yield ("use", path, start, used, name, None, start + at[i], None, None, None, shown, columns[i])
        elif kind in STRUCTS or kind in TYPEDEFS and any(w in (e["typeref"] or "").lower() or w in body.lower() for w in ("struct", "class", "union")):
            yield ("struct", path, start, name, None, None, start, end, None, None, body, None)
        elif kind in VARIABLES and "(" not in head:
            yield ("global", path, start, name, None, None, start, end, static, head.lstrip().startswith("extern "), body, None)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, text, entries in zip(*(c.to_pylist() for c in batch.columns)):
            rows = list(parts_of(path, text or "", entries or []))
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 10_000]), _PARTS)], schema=_PARTS)


def index_parts(files: DataFrame, tags: DataFrame) -> DataFrame:
    """``files(path, text)`` and ``tags`` as a tagger's reader gives them, to the rows of all kinds that the tables of an index
    are made from. Entries of files that are not there are left out."""
    own_name = F.when(F.lower("kind").isin(*VARIABLES), F.col("name")).otherwise(qualified_name(F.col("name"), F.col("scope")))
    entry = F.struct(own_name.alias("name"), "kind", "line", "end", "signature", return_type(F.col("typeref")).alias("return_type"), "typeref", F.coalesce(F.col("extras").contains("fileScope"), F.lit(False)).alias("file_scope"))
    entries = tags.select(normal_path(F.col("path")).alias("path"), entry.alias("e")).groupBy("path").agg(F.collect_list("e").alias("entries"))
    return files.select(normal_path(F.col("path")).alias("path"), "text").join(entries, "path").select("path", "text", "entries").mapInArrow(_parts, PARTS)


def index_tables(parts: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index, from written ``parts`` and ``files(path)``: files, functions, structs, globals, calls and
    references. Numbers are hashes of what they number, so tables made at different times agree."""
    number = lambda *columns: F.xxhash64(*columns)
    file_id = number("file_path").alias("file_id")
    all_files = files.select(normal_path(F.col("path")).alias("file_path")).distinct().select(file_id, "file_path")
    of = lambda part: parts.filter(F.col("part") == part).withColumnRenamed("path", "file_path").withColumn("file_id", number("file_path"))
    # An entry that repeats is one definition.
    functions = of("function").dropDuplicates(["file_path", "start_line", "name"]).select(number("file_path", "start_line", "name").alias("function_id"), "name", "signature", "return_type", "file_id", "file_path", "start_line", "end_line", "is_static", F.when(F.col("is_static"), "static").otherwise("extern").alias("linkage"), "body")
    structs = of("struct").dropDuplicates(["file_path", "start_line", "name"]).select(number("file_path", "start_line", "name").alias("struct_id"), "name", "file_id", "file_path", "start_line", "end_line", F.col("body").alias("definition"))
    variables = of("global").dropDuplicates(["file_path", "start_line", "name"]).select(number("file_path", "start_line", "name").alias("global_id"), "name", "file_id", "file_path", "start_line", "end_line", "is_extern", "is_static", F.col("body").alias("definition"))
    calls = of("call").select(number("file_path", "owner_line", "signature").alias("caller_id"), F.col("name").alias("callee_name"), "file_id", F.col("start_line").alias("line"), F.col("column_at").alias("column"))
    by_id = functions.select("function_id", "name")
    resolved = resolve_calls(calls.distinct(), by_id).join(by_id.withColumnsRenamed({"function_id": "callee_function_id", "name": "_full"}), "callee_function_id", "left")
    calls = resolved.select("caller_id", F.coalesce("_full", "callee_name").alias("callee_name"), "callee_function_id", "file_id", "line", "column").distinct()
    uses = of("use").select(number("file_path", "owner_line", "signature", "name", "start_line", "column_at").alias("ref_id"), "name", "file_id", number("file_path", "owner_line", "signature").alias("function_id"), F.col("start_line").alias("line"), F.col("column_at").alias("column"), F.col("body").alias("text")).dropDuplicates(["ref_id"])
    # Names that no global has need no look-up.
    known = uses.join(variables.select("name").distinct(), "name", "left_semi")
    references = resolve_globals(known, variables).select("global_id", "name", "file_id", "function_id", "line", "column", F.trim("text").alias("context"), access_type(F.col("name"), F.col("text")).alias("access_type"))
    return {"files": all_files, "functions": functions, "structs": structs, "globals": variables, "calls": calls, "references": references}
