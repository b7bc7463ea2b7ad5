"""Files of test cases (YAML or JSON with a list ``cases``) as typed rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLDS = "recall_at_1:double,recall_at_3:double,recall_at_5:double,min_mrr:double"
#: The fields of each kind of case.
KINDS = {
    "retrieval": f"id string, query string, term string, query_type string, search_mode string, expected struct<relevant_document_ids:array<string>,thresholds:struct<{THRESHOLDS}>,min_mrr:double,min_hits:int>",
    "indexing": "id string, source_id string, document_id string, expected struct<ingest_state:string,probe_verdicts:map<string,string>>",
    "gates": (
        "id string, description string, synth_output struct<output:struct<answer:string,citations:array<struct<claim:string,chunk_id:string>>,coverage_verdict:string,qualification:string>,"
        "metadata:struct<question:string,ask_type:string,sub_query_ledger:map<string,string>>>, ranked_chunks array<struct<point_id:string,text:string,document_id:string>>, "
        "expected struct<exit_code:int,all_claims_cited:boolean,all_cited_ids_in_input:boolean,groundedness_pass:boolean,coverage_ledger_consistent:boolean>"
    ),
    "summaries": (
        "id string, input struct<source_path:string,source:string>, agent_output struct<output:struct<summary_text:string>>, must_contain_entities array<string>, "
        "expected struct<required_sections:array<string>,must_contain_entities:array<string>,compression_ratio_bounds:struct<min:double,max:double>,passed:boolean>"
    ),
}


class NoCases(ValueError):
    """A file that cannot be read as cases, or holds none."""


def bodies(content: bytes) -> list[str]:
    """Each case of a file as JSON."""
    data = yaml.safe_load(content.decode("utf-8"))  # JSON is YAML
    found = data.get("cases") if isinstance(data, dict) else None
    if not isinstance(found, list) or not found:
        raise NoCases("no list of cases")
    return [json.dumps(c, default=str) for c in found]


def read_cases(spark: SparkSession, kind: str, *paths: str) -> DataFrame:
    """path, nr and the fields of the kind, a row for each case. Raises NoCases for a file without any.

    Files come through Spark's binary reader, so from any store that it reads, and are parsed where they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found, error = bodies(content), None
                except (yaml.YAMLError, UnicodeDecodeError, NoCases) as e:
                    found, error = [None], str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string()), pa.array([error] * len(found), pa.string())], ["path", "nr", "body", "error"])

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    told = files.mapInArrow(run, "path string, nr int, body string, error string")
    if bad := told.where("error IS NOT NULL").select("path", "error").head(5):
        raise NoCases("; ".join(f"{r.path}: {r.error}" for r in bad))
    typed = told.select("path", "nr", F.from_json("body", KINDS[kind]).alias("~case"))
    if typed.isEmpty():
        raise NoCases("no file of cases")
    return typed.select("path", "nr", "~case.*")
