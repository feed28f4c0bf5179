"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed one after another into the bits of as many 64-bit words as
they need: a start bit and one bit for each character of a rule. For every byte
value there is a mask of the bits it may enter and a mask of the bits that loop on
it. One Shift-And step a byte, ``D = (D << 1 & enter) | (D & loop)`` with carries
between words, runs all rules over a URL at once, and a batch of URLs together.

Globs match a whole canonical URL: ``.host/path`` with the host's A-Z lower-cased,
no scheme, no fragment. ``*`` stands for any run of bytes without ``/``, ``**``
for any run, ``?`` for one byte. Rules see ``.host/path`` without the query, so that
none fits inside one. Host and path are found with column functions.

A null url or one without ``://`` has empty host and path; no rule fits it, and
globs see the empty string. Rows may repeat, other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, fresh, table, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query: verdict, host, path (fixed values).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: What the method blocks where no rule fits (fixed values).
BLOCK_GLOBS = ("**.spam-*/**", "**.spam-*", "**.cheap-*/**", "**.cheap-*", "**/casino*/**", "**.exe")


@dataclass
class Automaton:
    """Masks of packed globs: [256, words] to enter and to loop, [words] to start, and the word and bit of every glob's end."""

    enter: np.ndarray
    loop: np.ndarray
    start: np.ndarray
    ends: list[tuple[int, int]]

    @classmethod
    def of(cls, globs: list[str]) -> Automaton:
        parsed = []
        for glob in globs:
            raw, states = glob.encode(), [[None, ""]]  # what enters the state, and what loops there
            i = 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    states[-1][1], i = "all", i + 2
                elif raw[i : i + 1] == b"*":
                    states[-1][1], i = states[-1][1] or "part", i + 1
                else:
                    states.append([raw[i], ""])
                    i += 1
            parsed.append(states)
        words = max(1, -(-sum(map(len, parsed)) // 64))
        out = cls(np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), [])
        at = 0
        for states in parsed:
            out.start[at // 64] |= np.uint64(1 << at % 64)
            for enter, loop in states:
                word, bit = at // 64, np.uint64(1 << at % 64)
                if enter == ord("?"):
                    out.enter[:, word] |= bit
                elif enter is not None:
                    out.enter[enter, word] |= bit
                if loop:
                    out.loop[:, word] |= bit
                if loop == "part":
                    out.loop[ord("/"), word] &= ~bit
                at += 1
            out.ends.append(((at - 1) // 64, (at - 1) % 64))
        return out

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """Which globs match which URLs: a boolean [URLs, globs]. Longer URLs stay in the batch while shorter ones have ended."""
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(urls) or b"\0", np.uint8)
        firsts = (np.cumsum(lengths) - lengths)[order]
        sorted_lengths = lengths[order]
        state = np.tile(self.start, (len(urls), 1))
        for k in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-sorted_lengths, -k, side="left"))  # those longer than k
            byte, d = data[firsts[:n] + k], state[:n]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = moved & self.enter[byte] | d & self.loop[byte]
        out = np.empty((len(urls), len(self.ends)), bool)
        for g, (word, bit) in enumerate(self.ends):
            out[order, g] = state[:, word] >> np.uint64(bit) & np.uint64(1) == 1
        return out


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """df with host, path, rule (null where none fits) and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's;
    of several the longest wins. Where none fits, verdict is block if one of
    block_globs matches, else allow.
    """
    df = without(df, [c for c in ("host", "path") if c != url])
    place_name, whole_name = fresh(df, "place_of_url", "whole_of_url")
    rules = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    globs = [f"*.{host}{path}**" for _, host, path in rules]
    names, verdicts = [h + p for _, h, p in rules], [v for v, _, _ in rules]
    tail = F.when(F.instr(F.col(f"`{url}`"), "://") > 0, F.substring(F.col(f"`{url}`"), F.instr(F.col(f"`{url}`"), "://") + 3, F.length(F.col(f"`{url}`"))))
    tail = F.coalesce(tail, F.lit(""))
    host = F.translate(F.regexp_extract(tail, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(tail, r"^[^?#]*(\?[^#]*)?", 1)
    canonical = F.when(F.concat(host, path, rest) == "", F.lit("")).otherwise(F.concat(F.lit("."), host, path, rest))
    place = F.when(F.concat(host, path) == "", F.lit("")).otherwise(F.concat(F.lit("."), host, path))
    fields = [("rule", "string"), ("verdict", "string")]

    def factory():
        of_rules, of_blocks = Automaton.of(globs), Automaton.of(list(block_globs))

        def compute(batch):
            raw = lambda name: batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
            ruled, blocked = of_rules.matches(raw(place_name)), of_blocks.matches(raw(whole_name)).any(1)
            first, any_rule = ruled.argmax(1) if len(rules) else np.zeros(len(ruled), int), ruled.any(1)
            rule = [names[r] if a else None for r, a in zip(first, any_rule, strict=True)]
            return [rule, [verdicts[r] if a else "block" if b else "allow" for r, a, b in zip(first, any_rule, blocked, strict=True)]]

        return compute

    return append_columns(df.withColumns({"host": host, "path": path, place_name: place, whole_name: canonical}), fields, factory).drop(place_name, whole_name)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


#: The globs of BLOCK_GLOBS as regular expressions.
SQL = r"""
WITH t AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(tail, '^[^?#]*(\?[^#]*)?', 1) AS query FROM t),
r AS (
  SELECT *, '.' || host || path || query AS u, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(u, '(?s)^.*\.spam-[^/]*(/.*)?$|^.*\.cheap-[^/]*(/.*)?$|^.*/casino[^/]*/.*$|^.*\.exe$') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
