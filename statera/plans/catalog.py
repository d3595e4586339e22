"""Registry of named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.rows import bounded_batches, spread
from ..functions.text import CORPUS_ENTITIES, INVISIBLE, MARKUP_ENTITIES, WS, WS_CHARS

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, run, sql)
        return run

    return add


TEXT_KEYS = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table ahead of costly per-text work."""
    return bounded_batches(spread(table(spark, sf_dir, name), *TEXT_KEYS[name]))


# --- SQL fragments shared by the twins -------------------------------------------------------


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"trim({x}, {lit(WS_CHARS)})"


def sql_replace(x: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def sql_collapse(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, {lit(WS + '+')}, ' ', 'g')")


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(WS + '+')}), lambda w: w <> '')"


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def sql_normalize(x: str) -> str:
    out = sql_replace(f"nfc_normalize(coalesce({x}, ''))", CORPUS_ENTITIES)
    for pattern, to in (
        ("<[^>]+>", ""), ("\r\n", "\n"), ("\r", "\n"), ("\t", " "), (" +", " "), ("\n{3,}", "\n\n"),
        (f"§{WS}+([0-9]+)", "§\\1"), (f"Abs\\.{WS}+([0-9]+)", "Abs. \\1"), (f"Nr\\.{WS}+([0-9]+)", "Nr. \\1"),
    ):
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(to)}, 'g')"
    return sql_strip(out)


def sql_text_nodes(x: str) -> str:
    visible = f"replace(regexp_replace({x}, {lit(INVISIBLE)}, '<!>', 'g'), '&nbsp;', ' ')"
    return (
        f"list_filter(list_transform(regexp_split_to_array({visible}, '<[^>]+>'), "
        f"lambda n: {sql_strip('n')}), lambda n: n <> '')"
    )


def sql_decode(x: str) -> str:
    return sql_replace(x, MARKUP_ENTITIES)
