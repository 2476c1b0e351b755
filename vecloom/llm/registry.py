"""The ten corpus queries and the SQL of those that SQL can express over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import covertree, langid, leaks, mixing, privacy, repeats, resample, simhash, tokenfile, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_cover_tree": covertree.op2_cover_tree,
        "op3_simhash": simhash.op3_simhash,
        "op4_mixing": mixing.op4_mixing,
        "op5_language": langid.op5_language,
        "op6_resample": resample.op6_resample,
        "op7_token_file": tokenfile.op7_token_file,
        "op8_leaks": leaks.op8_leaks,
        "op9_privacy": privacy.op9_privacy,
        "op10_repeats": repeats.op10_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op2_cover_tree": covertree.OP2_SQL, "op8_leaks": leaks.OP8_SQL, "op10_repeats": repeats.OP10_SQL}
