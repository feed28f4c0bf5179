"""Strings, hashes and the strict score parser, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def selection_key(seed: int, unit) -> Column:
    """Order of hash-based selection: sha256 of "seed:id"."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), _c(unit).cast("string")), 256)


def request_id(model: str, condition: str, unit) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{model}|{condition}|"), _c(unit).cast("string")), 256), 1, 16)


def safe_name(judge, condition) -> Column:
    return F.replace(F.concat(_c(judge), F.lit("__"), _c(condition)), F.lit("/"), F.lit("_"))


def render(template: str, values: list[tuple[str, Column]]) -> Column:
    """template with placeholders replaced literally, one after another; later ones also inside earlier values."""
    out = F.lit(template)
    for placeholder, value in values:
        out = F.replace(out, F.lit(placeholder), F.coalesce(value, F.lit("")))
    return out


def insert_before(text: Column, marker: str, extra: str) -> Column:
    """extra put before the first marker; text as it is where there is none."""
    at = F.locate(marker, text)
    return F.when(at > 0, F.overlay(text, F.lit(extra), at, F.lit(0))).otherwise(text)


def strict_score(response, low: int = 1, high: int = 6) -> Column:
    """The score of a response that is a JSON object of the one key "score" with a whole number in range; else null.

    The kind of the value is that of the text: 3.0, "3" and true are not whole
    numbers. An object that repeats the key is refused.
    """
    kind, parsed = _kind(response)
    value = F.try_variant_get(parsed, "$.score", "bigint")
    return F.when((kind == "OBJECT<score: BIGINT>") & value.between(low, high), value.cast("int"))


def _kind(response) -> tuple[Column, Column]:
    trimmed = F.regexp_replace(_c(response), r"^\s+|\s+$", "")
    parsed = F.try_parse_json(trimmed)
    return F.coalesce(F.schema_of_variant(parsed), F.lit("")), parsed


def refusal(response, low: int = 1, high: int = 6) -> Column:
    """Why strict_score is null: not json, wrong keys, wrong type or out of range; null for a valid response."""
    kind, parsed = _kind(response)
    value = F.try_variant_get(parsed, "$.score", "bigint")
    return (
        F.when(F.coalesce(_c(response), F.lit("")).rlike(r"^\s*$") | (kind == ""), "not json")
        .when(~kind.startswith("OBJECT<score: ") | kind.contains(", "), "wrong keys")
        .when(kind != "OBJECT<score: BIGINT>", "wrong type")
        .when(~value.between(low, high), "out of range")
    )


def fake_judge(name: str, prompt, levels: int = 6, invalid_every: int | None = None) -> Column:
    """A response that depends on a hash of the judge's name and the prompt alone; every so many are not valid."""
    digest = F.sha2(F.concat(F.lit(name), F.lit("\x00"), _c(prompt)), 256)
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("bigint")
    good = F.format_string('{"score": %d}', (F.lit(1) + number(1, 2) % levels).cast("int"))
    if not invalid_every:
        return good
    return F.when(number(17, 8) % invalid_every == 0, F.lit("no score")).otherwise(good)


def uniform(seed: str, *parts) -> Column:
    """A number in [0, 1) from 52 bits of sha256 of seed and parts: the same in any engine and partitioning."""
    text = F.concat_ws(":", F.lit(seed), *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def epoch_seconds(ts) -> Column:
    return F.unix_micros(F.to_timestamp(_c(ts))) / 1_000_000
