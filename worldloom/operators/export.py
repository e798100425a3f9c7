"""Exports of a dump: nested JSON per object, flat files per object, and program listings."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldloom.functions import moo
from worldloom.operators.inspect import World, code_lines


def listings(w: World, numbered: bool = False) -> DataFrame:
    """``oid, name, text``: each program as text under its ``@program`` line; absent programs have none."""
    line = F.transform("code", lambda x, i: F.format_string("%3d:  %s", i + 1, x) if numbered else F.coalesce(x, F.lit("")))
    head = F.concat(F.lit("@program #"), F.col("oid").cast("string"), F.lit(":"), F.get(F.split("name", " "), F.lit(0)))
    return w.verbs.filter("code IS NOT NULL").select("oid", "name", F.array_join(F.concat(F.array(head), line, F.array(F.lit("."))), "\n").alias("text"))


def nested_json(w: World) -> DataFrame:
    """``id, json``: an object with its properties and verbs; grouped per object, so as large as the object."""
    p = w.properties.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("slot", "name", "owner", "perms", "value_json"))).alias("properties"))
    v = w.verbs.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("verb_index", "name", "owner", "perms", "preps", "code"))).alias("verbs"))
    o = w.objects.select("id", "name", "flags", "owner", "location", "parents")
    every = o.join(p.withColumnRenamed("oid", "id"), "id", "left").join(v.withColumnRenamed("oid", "id"), "id", "left")
    return every.select("id", F.to_json(F.struct("id", "name", "flags", "owner", "location", "parents", "properties", "verbs"), {"ignoreNullFields": "false"}).alias("json"))


def write_flat(w: World, folder: str) -> DataFrame:
    """Write one file per program into the shared ``folder``, from the executors; returns names and sizes.

    A file is written under another name first and then moved, so a repeated task leaves the same file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"]):
                full = os.path.join(folder, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                part = f"{full}.{os.getpid()}"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(part, full)
                out.append((path, len(text.encode())))
            yield pd.DataFrame(out, columns=["path", "size"])

    named = listings(w).join(w.verbs.select("oid", "name", "verb_index"), ["oid", "name"])
    path = F.concat(F.col("oid").cast("string"), F.lit("/"), F.col("verb_index").cast("string"), F.lit("-"), moo.file_name(F.get(F.split("name", " "), F.lit(0))), F.lit(".moo"))
    return named.select(path.alias("path"), "text").mapInPandas(run, "path string, size bigint")


def first_difference(a: DataFrame, b: DataFrame, key: list[str], text: str) -> DataFrame:
    """``*key, line_no``: the first line in which two texts of a key differ, from 1; one past the shorter if it is a head of the other."""
    lines = lambda d, c: d.select(*key, F.split(text, "\n").alias(c))
    j = lines(a, "__a").join(lines(b, "__b"), key)
    pairs = F.arrays_zip("__a", "__b")
    at = F.array_min(F.filter(F.transform(pairs, lambda p, i: F.when(~p["__a"].eqNullSafe(p["__b"]), i + 1)), lambda x: x.isNotNull()))
    return j.select(*key, at.alias("line_no")).filter("line_no IS NOT NULL")


def numbers_in_code(w: World, ids: DataFrame) -> DataFrame:
    """``oid, verb, line_no, id``: plain numbers and object numbers in code outside strings that are in ``ids(id)``."""
    n = code_lines(w, True).select("oid", "verb", "line_no", F.explode(F.regexp_extract_all("seen", F.lit(r"(?<![\w.])#?(\d+)(?![\w.])"), F.lit(1))).alias("n"))
    hit = n.select("oid", "verb", "line_no", F.col("n").try_cast("bigint").alias("id")).join(ids.select("id"), "id", "left_semi")
    return hit.select("oid", "verb", "line_no", "id").distinct()
