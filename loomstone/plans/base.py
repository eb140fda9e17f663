"""Registry of queries and the SQL fragments that their DuckDB equivalents share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstone.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Callable[[str], DataFrame]], DataFrame]], Query]:
    """Register a query; its function is given a reader of tables by name."""

    def wrap(build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda t: table(spark, sf_dir, t))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return wrap


def lit(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def unix(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def newlines(x: str) -> str:
    return strip(rf"regexp_replace({unix(x)}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[a-zA-Z]+(?:''[a-zA-Z]+)?')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '\S+')"


def any_of(x: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(p)})" for p in phrases) + ")"


def starts(x: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"starts_with({x}, {lit(p)})" for p in phrases) + ")"


def blocks(x: str) -> str:
    return rf"string_split_regex({unix(x)}, '\n[ \t]*(?:\n[ \t]*)+')"


def joined(x: str) -> str:
    return f"md5(array_to_string({x}, '|'))"


def turns(x: str) -> str:
    """Roles and contents of the turns of a rendered conversation, as a list of structs."""
    marked = rf"regexp_replace({unix(x)}, '(?m)^(User|Assistant): ?', chr(1) || '\1' || chr(2), 'g')"
    parts = f"[p for p in string_split({marked}, chr(1)) if contains(p, chr(2))]"
    return rf"[{{'role': lower(split_part(t, chr(2), 1)), 'content': regexp_replace(split_part(t, chr(2), 2), '\n+$', '')}} for t in {parts}]"


def fraction(seed: int, x: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {x}), 1, 8))::BIGINT / 4294967296.0)"
