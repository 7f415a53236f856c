"""External models as batch functions over rows, with results remembered by key.

A model is the caller's: a function over Arrow batches.  ``PAYLOADS`` says what each task's
model is given and gives back, and ``infer`` checks both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T

Batches = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_REGISTRY: dict[str, tuple[Batches, str]] = {}

#: What each task's model takes, and what it adds.
PAYLOADS: dict[str, tuple[str, str]] = {
    "morphosyntax": ("words array<string>, terminator string, lang string", "sentence array<struct<id:int,id_end:int,decimal:boolean,text:string,lemma:string,upos:string,feats:string,head:int,deprel:string>>"),
    "utseg": ("words array<string>, lang string", "trees array<string>"),
    "translate": ("text string, lang string", "translation string"),
    "coref": ("sentences array<struct<line_idx:bigint,words:array<string>>>", "annotations array<struct<sentence_idx:int,words:array<array<struct<chain_id:bigint,is_start:boolean,is_end:boolean>>>>>"),
    "fa": ("words array<string>, audio string, start_ms bigint, end_ms bigint", "tokens array<struct<text:string,time_s:double>>"),
    "asr": ("audio string, lang string", "elements array<struct<value:string,start_s:double,end_s:double,speaker:int>>"),
    "speaker": ("audio string", "segments array<struct<start_ms:bigint,end_ms:bigint,speaker:string>>"),
    "opensmile": ("audio string", "features array<struct<frame:int,name:string,value:double>>"),
    "avqi": ("audio string", "cpps double, hnr double, shim double, shdb double, slope double, tilt double"),
}


#: Rows that a model is given at once: a row may be a sentence or a document, and its result many times as large.
MODEL_ROWS = 256


def few_rows(function: Batches) -> Batches:
    """The model over batches of ``MODEL_ROWS`` rows at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return function(b.iloc[k : k + MODEL_ROWS].reset_index(drop=True) for b in batches for k in range(0, len(b), MODEL_ROWS))

    return run


def register(task: str, function: Batches, schema: str) -> None:
    """Names a model's function over Arrow batches and the schema it returns."""
    _REGISTRY[task] = (function, schema)


def infer(df: DataFrame, task: str) -> DataFrame:
    """Applies a registered model; columns that the task's payload or result lacks are an error before anything runs."""
    if task not in _REGISTRY:
        raise LookupError(f"no model for task {task}")
    function, schema = _REGISTRY[task]
    for fields, names in zip(PAYLOADS.get(task, ("", "")), (df.columns, T._parse_datatype_string(schema).names), strict=True):
        lacking = {f.name for f in T._parse_datatype_string(fields)} - set(names) if fields else set()
        if lacking:
            raise ValueError(f"task {task} lacks {', '.join(sorted(lacking))}")
    return df.mapInPandas(few_rows(function), schema)


def cached_map(df: DataFrame, cache: DataFrame, key: str, task: str) -> tuple[DataFrame, DataFrame]:
    """Results for all rows and the new entries for the cache; only keys that it lacks reach the model, once each."""
    missing = df.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    new = infer(missing, task)
    return df.select(key).join(cache.unionByName(new), key), new
