"""Review titles with a caller-supplied scorer.

The scorer is a function ``list[str] -> list[str]`` (one response per
prompt); it runs inside ``mapInPandas`` on Arrow batches, so prompts never
pass through the driver. A prompt on which the scorer fails keeps its row with
an ``ERROR:`` reason; the others of its batch are not affected. Responses
are parsed by P22.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from titlelake.functions.records import parse_verdict, review_prompt


def scored(scorer: Callable[[list[str]], list[str]], prompts: list[str]) -> list[tuple]:
    """(response, error) of each prompt: all at once, or one by one where the
    scorer fails or gives another number of responses, so that a prompt's result
    does not depend on the batch it travels in."""
    try:
        answers = list(scorer(prompts))
        if len(answers) == len(prompts):
            return [(a, None) for a in answers]
        if len(prompts) == 1:
            raise ValueError("scorer returned a different number of responses")
    except Exception as e:  # noqa: BLE001 -- a failed call keeps the row
        if len(prompts) == 1:
            return [(None, str(e))]
    return [scored(scorer, [p])[0] for p in prompts]


def review(df: DataFrame, scorer: Callable[[list[str]], list[str]], criteria: str,
           title: str = "title", channel: str = "channelTitle", tags: str = "tags") -> DataFrame:
    """Input rows + ``keep`` and ``reason``."""
    cols = df.columns
    prompted = df.withColumn("__prompt", review_prompt(title, channel, tags, criteria))
    schema = T.StructType(list(prompted.schema.fields) + [T.StructField("__response", T.StringType()),
                                                          T.StructField("__error", T.StringType())])

    def run(batches):
        for pdf in batches:
            prompts = pdf["__prompt"].tolist()
            pairs = scored(scorer, prompts)
            pdf = pdf.assign(__response=pd.Series([r for r, _ in pairs], index=pdf.index, dtype="object"),
                             __error=pd.Series([e for _, e in pairs], index=pdf.index, dtype="object"))
            yield pdf

    answered = prompted.mapInPandas(run, schema)
    v = parse_verdict("__response", "__error")
    return answered.select(*cols, v["keep"].alias("keep"), v["reason"].alias("reason"))
