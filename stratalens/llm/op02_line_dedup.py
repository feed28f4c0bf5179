"""Line deduplication by an exact set-similarity join of lines.

A line's set is that of its words. Two lines match where they share at least 80
hundredths of their union. A line is removed if any earlier line of the corpus
matches it; earlier is by doc_id, then by the text's hash among rows of one id,
then by line number. Lines without words are never removed.

Lines of equal sets are one node, whose first line is the earliest; the others go.
Words are ordered by rarity. A node is posted under the words of its prefix. Words of
over HEAVY occurrences are keys in pairs only: they fall into m classes by hash, m
growing with the set's size, and the prefix is as many words longer, so that similar
sets share m + 1 words there and hence two of one class. A node is posted under the
pairs inside its classes, a few for each word of its prefix. Postings are dealt by
groups of keys, in bundles, and meet by key, where length, position and a 128-bit
signature of parities leave few candidate pairs. Of a node's candidates under a key the BEST nearest are
written, so that a group of copies is never turned into all its pairs, and a node
with more is marked there. Nearest candidates are verified on whole sets, then all others
of the nodes that these don't settle. Marked nodes that are still open ask again, where
they are marked, for eight times as many candidates or more, until none is left. One match settles a node: it
goes with all its lines.

In groups of over LARGE postings every node is compared with HUBS early ones of the
key alone, and marked; a group of any size passes in the memory of a batch.

Words are identified by 56-bit hashes, sets by 64-bit digests. Null texts have no
lines. Rows equal in id and text are one document: each keeps the same lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, append_columns, fresh, lean, table, tidy, without
from .setjoin import BROADCAST_DOCS, DEN, NUM, differing, room, similar
from .tokens import Levels, blocks, levels, mix, word_hashes

BITS = 20
#: A word of more occurrences than this is a key only together with another word.
HEAVY = 1024
#: Groups of more postings than this are compared with HUBS early nodes alone, at first.
LARGE = 1024
HUBS = 64
#: Candidates of a node that are written for each key.
BEST = 3
#: Rows that meet at once, about, and pairs that wait for the choice of the best.
ROWS, PAIRS = 1 << 18, 1 << 20
#: Postings of a group of keys, about, and bytes of a batch of bundled ones.
GROUP, BUNDLES = 1 << 17, 4 << 20
#: Up to so many numbers (8 MB) are sent to all executors.
BROADCAST_NUMBERS = 1_000_000
#: Candidates that asking nodes may get in all, at least, by key.
ASKED = 1 << 22
#: Sets of up to so many words have the 128 bits as their only signature.
SHORT = 128

_ONE = np.uint64(0x9E3779B97F4A7C15)
#: A posting's fields: coarse order (11 bits), set size (30), position (22).
_POS, _N = 22, 30


def word_parts(column: pa.Array):
    for data, firsts, _ in blocks(column):
        yield word_hashes(data, firsts)[0]


def prefix_lengths(n: np.ndarray) -> np.ndarray:
    """setjoin.prefix_length of every number."""
    return np.minimum(n, n + (-NUM * n) // DEN + 1)


def classes(n: np.ndarray) -> np.ndarray:
    """Into how many classes the heavy words of a set of n fall: the most of 1, 2, 4, ... up to half its prefix. Never fewer for more words."""
    return 1 << np.frexp(np.maximum(prefix_lengths(n) // 2, 1))[1].astype(np.int64) - 1


def lengthening(n: np.ndarray) -> np.ndarray:
    """The classes of the largest set that one of n can match: by so many words its prefix is longer."""
    return classes(n * DEN // NUM)


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in some (sorted)."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def few_numbers(df: DataFrame, column: str) -> np.ndarray | None:
    """The numbers of a column, sorted, if there are at most BROADCAST_NUMBERS, to leave out early what joins would; None beyond."""
    if df.count() > BROADCAST_NUMBERS:
        return None
    return np.unique(np.array([r[0] for r in df.select(column).collect()], np.int64))


def in_order(group: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The order by group (ascending already), then key. One sort of the group's number before the key's first bits, unless equal ones differ."""
    width = max(1, int(group[-1]).bit_length())
    both = group.astype(np.uint64) << np.uint64(64 - width) | keys >> np.uint64(width)
    order = np.argsort(both)
    both, whole = both[order], keys[order]
    same = both[1:] == both[:-1]
    return np.lexsort((keys, group)) if (whole[1:][same] != whole[:-1][same]).any() else order


def signatures(keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """setjoin.signature of the sets of n keys that begin at places at of keys; null for those of up to SHORT, whose only one are low and high."""
    if (n <= SHORT).all():
        return pa.nulls(len(n), pa.list_(pa.int64()))
    words = np.where(n <= SHORT, 0, 1 << np.frexp(n - 1)[1].astype(np.int64) >> 4)
    ends = np.cumsum(np.r_[0, words])
    flat = np.empty(ends[-1], np.int64)
    for w in np.unique(words[n > SHORT]).tolist():
        these = np.flatnonzero(words == w)
        size = n[these]
        own = keys[np.repeat(at[these] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        place = np.repeat(np.arange(len(these)) * (64 * w), size) + (own & np.uint64(64 * w - 1)).astype(np.int64)
        odd = np.bincount(place, minlength=len(these) * 64 * w) & 1
        flat[ends[these][:, None] + np.arange(w)] = np.packbits(odd.astype(bool), bitorder="little").view(np.int64).reshape(-1, w)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array(n <= SHORT))


def binaries(values: np.ndarray, length: np.ndarray) -> pa.Array:
    """Binary values of length of these numbers each: in the JVM one value instead of many."""
    ends = np.cumsum(np.r_[0, length]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def numbers(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """What binaries() was made of."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype) if data is not None and ends[-1] > ends[0] else np.zeros(0, dtype)
    return values, np.diff(ends).astype(np.int64) // values.itemsize


def ranks(ids: pa.Array, ths: pa.Array) -> np.ndarray:
    """Numbers in the order of (id, hash), null ids first, equal for equal ones."""
    order = pa.compute.sort_indices(pa.table({"id": ids, "th": ths}), sort_keys=[("id", "ascending"), ("th", "ascending")], null_placement="at_start").to_numpy()
    ids, ths = ids.take(pa.array(order)), ths.take(pa.array(order)).to_numpy()
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    same = pa.compute.equal(ids[1:], ids[:-1]).fill_null(False).to_numpy(zero_copy_only=False) | ~(valid[1:] | valid[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.r_[False, ~(same & (ths[1:] == ths[:-1]))])[: len(order)]
    return out


def first_places(node: np.ndarray, rank: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines come first of their node by (rank, line), one a node, and which come later."""
    order = np.lexsort((line, rank, node))
    new = np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]])
    first = np.repeat(order[new], np.diff(np.r_[new, len(order)]))
    return np.sort(order[new]), np.sort(order[(rank[order] != rank[first]) | (line[order] != line[first])])


def line_rows(docs: DataFrame, known: Levels, what: str, heavy: int = HEAVY) -> DataFrame:
    """Rows for the lines with words of docs (doc_id, th, text): doc_id, th, line, node, and what.

    what is ``prefix``, for n, low and high (128 parities), sign (longer parities of long
    sets) and prefix (its keys' bytes), longer by lengthening(n) if it has a heavy key; or ``keys``, for the whole
    sets of only those lines whose numbers are in docs' array column ``wanted``.
    With ``prefix``, of lines of one node that are worked on together only the first has these:
    the others' rows have nothing but their place, and a null node.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    more = {"keys": ", keys array<long>", "prefix": ", n int, low long, high long, sign array<long>, prefix binary"}[what]
    id_type = docs.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, th long, line int, node long{more}"
    least = Levels.level_of(heavy)
    # in Arrow's order as in Spark's
    alike = isinstance(id_type, (T.IntegralType, T.StringType))

    def run(batches):
        table = shared.value
        for batch in batches:
            ids, ths = batch.column(0), batch.column(1)
            rank = ranks(ids, ths) if what == "prefix" and alike else None
            wanted = batch.column(3) if what == "keys" else None
            last, base = -1, 0
            for data, firsts, rows in blocks(batch.column(2), at_lines=True):
                hashes, starts = word_hashes(data, firsts)
                places = np.flatnonzero(data == 10)
                feeds = np.searchsorted(places, starts)
                piece = np.searchsorted(firsts, starts, side="right") - 1
                # line feeds before each piece: in this block, and of the same text in earlier ones
                before = np.searchsorted(places, firsts)
                extra = np.zeros(len(rows), np.int64)
                if len(rows) and rows[0] == last:
                    extra[0] = base
                base = int(len(places) - before[-1] + (extra[-1] if len(rows) > 1 or rows[0] == last else 0))
                last = rows[-1]
                if not len(starts):
                    continue
                group = feeds + piece
                if wanted is not None:
                    line = feeds - before[piece] + extra[piece]
                    some = np.zeros(len(starts), bool)
                    for k, r in enumerate(rows.tolist()):
                        a, b = np.searchsorted(piece, [k, k + 1])
                        some[a:b] = np.isin(line[a:b], wanted[r].values.to_numpy())
                    hashes, group, starts = hashes[some], group[some], starts[some]
                    if not len(starts):
                        continue
                keys = table.keys(hashes)
                order = in_order(group, keys)
                keys, group, lead = keys[order], group[order], starts[order]
                new_line = np.r_[True, group[1:] != group[:-1]]
                unique = new_line | np.r_[True, keys[1:] != keys[:-1]]
                keys, new_line, lead = keys[unique], new_line[unique], lead[unique]
                at = np.flatnonzero(new_line)
                n = np.diff(np.r_[at, len(keys)])
                node = mix(np.add.reduceat(mix(keys * _ONE + np.repeat(n, n).astype(np.uint64)), at)).view(np.int64)
                first_word = lead[at]
                part = np.searchsorted(firsts, first_word, side="right") - 1
                line = np.searchsorted(places, first_word) - before[part] + extra[part]
                if rank is not None:
                    own, later = first_places(node, rank[rows[part]], line)
                    if len(later):
                        row = pa.array(rows[part[later]])
                        columns = {"doc_id": ids.take(row), "th": ths.take(row), "line": pa.array(line[later].astype(np.int32))}
                        columns |= {c: pa.nulls(len(later), t) for c, t in (("node", pa.int64()), ("n", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("sign", pa.list_(pa.int64())), ("prefix", pa.binary()))}
                        yield pa.RecordBatch.from_pydict(columns)
                    if len(own) < len(at):
                        kept = np.zeros(len(at), bool)
                        kept[own] = True
                        keys, at, n, node, part, line = keys[np.repeat(kept, n)], np.cumsum(n[own]) - n[own], n[own], node[own], part[own], line[own]
                row = pa.array(rows[part])
                columns = {"doc_id": ids.take(row), "th": ths.take(row), "line": pa.array(line.astype(np.int32)), "node": pa.array(node)}
                if what == "keys":
                    columns["keys"] = pa.ListArray.from_arrays(pa.array(np.r_[at, len(keys)], pa.int32()), pa.array(keys.view(np.int64)))
                else:
                    one, upper = np.uint64(1) << (keys & np.uint64(63)), keys & np.uint64(64) > 0
                    low, high = (np.bitwise_xor.reduceat(np.where(upper == part, one, np.uint64(0)), at).view(np.int64) for part in (False, True))
                    p = prefix_lengths(n)
                    p = np.where(keys[at + p - 1] >> np.uint64(56) >= least, np.minimum(n, p + lengthening(n)), p)
                    within = np.arange(len(keys)) - np.repeat(at, n)
                    columns |= {"n": pa.array(n.astype(np.int32)), "low": pa.array(low), "high": pa.array(high), "sign": signatures(keys, at, n)}
                    columns["prefix"] = binaries(keys[within < np.repeat(p, n)], p)
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "th", "text", *(["wanted"] if what == "keys" else [])).mapInArrow(tidy(run), schema)


ROW = np.dtype([(c, np.int64) for c in ("key", "node", "low", "high", "packed")])


def posted_rows(batch: pa.RecordBatch, least: np.uint64) -> np.ndarray:
    """The postings (ROW) of a batch of nodes (node, n, low, high, coarse, prefix)."""
    node, n, low, high, coarse = (batch.column(k).to_numpy() for k in range(5))
    n = n.astype(np.int64)
    keys, length = numbers(batch.column(5), np.uint64)
    row = np.repeat(np.arange(len(n)), length)
    within = np.arange(len(keys)) - np.repeat(np.cumsum(length) - length, length)
    inside, many = within < prefix_lengths(n)[row], keys >> np.uint64(56) >= least
    single, heavies = np.flatnonzero(inside & ~many), np.flatnonzero(many)
    cls = mix(keys[heavies]).view(np.int64) & (classes(n) - 1)[row[heavies]]
    by_class = np.lexsort((cls, row[heavies]))  # in the order of words inside a class
    heavies, cls = heavies[by_class], cls[by_class]
    new = np.flatnonzero(np.r_[True, (np.diff(cls) != 0) | (np.diff(row[heavies]) != 0)][: len(heavies)])
    size = np.diff(np.r_[new, len(heavies)])
    later = np.repeat(new + size, size) - np.arange(len(heavies)) - 1
    place = np.repeat(np.arange(len(heavies)), later)
    a, b = heavies[place], heavies[place + 1 + np.arange(len(place)) - np.repeat(np.cumsum(later) - later, later)]
    # up to lengthening - 1 shared words may come before the first pair of one class
    within[heavies] = np.maximum(within[heavies] - (lengthening(n) - 1)[row[heavies]], 0)
    at = np.r_[single, a]
    r = row[at]
    rows = np.empty(len(at), ROW)
    rows["key"] = np.r_[keys[single], mix(keys[a] * _ONE + mix(keys[b]))].view(np.int64)
    rows["node"], rows["low"], rows["high"] = node[r], low[r], high[r]
    rows["packed"] = (coarse[r].astype(np.int64) << (_POS + _N)) | (n[r] << _POS) | np.minimum(within[at], (1 << _POS) - 1)
    return rows


def able(nodes: DataFrame) -> DataFrame:
    """What posted_rows() needs of nodes. A set that is left out is out of reach for any of another size: n / (n + 1) is under the threshold."""
    return nodes.filter(F.col("n") * DEN >= (F.col("n") + 1) * NUM).select("node", "n", "low", "high", "coarse", "prefix")


def postings(nodes: DataFrame, heavy: int, only: np.ndarray | None = None) -> DataFrame:
    """key, node, low, high and packed (coarse, n and position) of nodes (node, n, low, high, coarse, prefix), with only those of some keys (sorted)."""
    least = Levels.level_of(heavy)
    shared = nodes.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        some = shared.value
        for batch in batches:
            rows = posted_rows(batch, least)
            if some is not None:
                rows = rows[among(rows["key"], some)]
            for k in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(rows[c][k : k + (1 << 16)]) for c in ROW.names], names=[*ROW.names])

    return able(nodes).mapInArrow(tidy(run), "key long, node long, low long, high long, packed long")


def bundles(nodes: DataFrame, heavy: int, groups: int) -> DataFrame:
    """grp and rows: the postings of nodes, bundled by group of keys, many of them in one binary value."""
    least = Levels.level_of(heavy)

    def bundled(parts):
        rows = np.concatenate(parts)
        group = (mix(rows["key"].view(np.uint64)) % np.uint64(groups)).astype(np.int32)
        order = np.argsort(group, kind="stable")
        rows, group = rows[order], group[order]
        # about BUNDLES bytes in a batch
        for k in range(0, len(rows), BUNDLES // ROW.itemsize):
            part, own = rows[k : k + BUNDLES // ROW.itemsize], group[k : k + BUNDLES // ROW.itemsize]
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), binaries(part, np.diff(np.r_[at, len(part)]))], names=["grp", "rows"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            parts.append(posted_rows(batch, least))
            size += len(parts[-1])
            if size >= ROWS:
                yield from bundled(parts)
                parts, size = [], 0
        if size:
            yield from bundled(parts)

    return able(nodes).mapInArrow(tidy(run), "grp int, rows binary")


def _found(x: np.ndarray, y: np.ndarray, d: np.ndarray, more: np.ndarray, unsure: np.ndarray, key: np.ndarray):
    for k in range(0, len(x), 1 << 16):
        s = slice(k, k + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[s], mask=d[s] < 0), pa.array(y[s]), pa.array(d[s].astype(np.int32)), pa.array(more[s]), pa.array(unsure[s]), pa.array(key[s], mask=~more[s])], names=["x", "y", "d", "more", "unsure", "key"])


def unsure(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether it is open which of rows a and b is the earlier, or both have longer signatures to compare."""
    (na, _), (nb, _) = Meeting.parts(a), Meeting.parts(b)
    return (a["packed"] >> (_POS + _N) == b["packed"] >> (_POS + _N)) | (np.minimum(na, nb) > SHORT)


class Meeting:
    """Postings in order of key; pairs of a key that pass the filters, the BEST of every node."""

    def __init__(self, large: int, hubs: int, best: int):
        self.large, self.hubs, self.best = large, hubs, best
        self.hub_key, self.hub_rows = None, None

    @staticmethod
    def parts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n, and how many keys a set can share from its posting on, of rows."""
        n = rows["packed"] >> _POS & (1 << _N) - 1
        return n, n - (rows["packed"] & (1 << _POS) - 1)

    @staticmethod
    def near(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the bits of rows a and b, of both keys in all, leave room for a match, and how many of them differ."""
        d = sum(np.bitwise_count((a[c] ^ b[c]).view(np.uint64)).astype(np.int64) for c in ("low", "high"))  # of signed numbers it would count the absolute value
        return d <= both - 2 * -(-NUM * both // (NUM + DEN)), d

    def meet(self, rows: np.ndarray, ended: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """What of rows must wait for the next ones, and the columns x, y, d, more of what was found. x is null (d < 0) for a mark alone."""
        wait, columns = self.pairs(rows, ended)
        return wait, columns[:4]

    def pairs(self, rows: np.ndarray, ended: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """meet() with unsure() and the key as further columns."""
        keys = rows["key"]
        new = np.r_[True, keys[1:] != keys[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(rows)])
        rows = rows[np.argsort(np.cumsum(new) << (_N + 1) | self.parts(rows)[0])]
        keys, wait = rows["key"], rows[:0]
        if not ended and size[-1] <= self.large and keys[-1] != self.hub_key:
            wait, rows = rows[first[-1] :], rows[: first[-1]]
            first, size = first[:-1], size[:-1]
        found: list[list[np.ndarray]] = [[], [], []]  # row of y, row of x, d
        more = np.zeros(len(rows), bool)
        marks, stars = [], []
        ordinary = size <= self.large
        if len(first) and keys[0] == self.hub_key:
            ordinary[0] = False

        def thin() -> None:
            y, x, d = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)
            order = np.lexsort((d, y))
            y, x, d = y[order], x[order], d[order]
            start = np.r_[True, y[1:] != y[:-1]] if len(y) else np.zeros(0, bool)
            rank = np.arange(len(y)) - np.repeat(np.flatnonzero(start), np.diff(np.r_[np.flatnonzero(start), len(y)]))
            more[y[rank >= self.best]] = True
            found[:] = [[c[rank < self.best]] for c in (y, x, d)]

        # ordinary groups: the smaller set comes first; its size and position bound the larger one's size
        group, here = np.repeat(np.arange(len(first)), size), np.arange(len(rows))
        n, most = self.parts(rows)
        share, reach = NUM * n, (NUM + DEN) * most
        end = np.searchsorted(group << (_N + 1) | n, group << (_N + 1) | np.maximum(reach // NUM - n, 0), side="right")
        count = np.where(ordinary[group], np.maximum(end - here - 1, 0), 0)
        total = np.cumsum(count)
        coarse, low, high = rows["packed"] >> (_POS + _N), rows["low"].copy(), rows["high"].copy()
        at, waiting = 0, 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(total, total[at] - count[at] + ROWS, side="right")))
            some = count[at:to]
            i = np.repeat(here[at:to], some)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
            fits = share[i] + share[j] <= reach[j]
            i, j = i[fits], j[fits]
            ok, d = self.near({"low": low[i], "high": high[i]}, {"low": low[j], "high": high[j]}, n[i] + n[j])
            i, j, d = i[ok], j[ok], d[ok]
            before, after = coarse[i] <= coarse[j], coarse[j] <= coarse[i]  # in one place either may be the earlier
            for c, part in zip(found, (np.r_[j[before], i[after]], np.r_[i[before], j[after]], np.r_[d[before], d[after]]), strict=True):
                c.append(part)
            waiting += len(i)
            if waiting > PAIRS:
                thin()
                waiting = 0
            at = to
        thin()
        y, x, d = (c[0] for c in found)
        out = [[rows["node"][x], rows["node"][y], d, more[y], unsure(rows[x], rows[y]), keys[y]]]

        # others: against the first nodes of the key's first batch
        for g in np.flatnonzero(~ordinary):
            group = rows[first[g] : first[g] + size[g]]
            if group["key"][0] != self.hub_key:
                self.hub_key, self.hub_rows = group["key"][0], group[np.argsort(group["packed"])[: self.hubs]]
            for k in range(0, len(group), ROWS // self.hubs):
                part = group[k : k + ROWS // self.hubs]
                a, b = np.tile(self.hub_rows, len(part)), np.repeat(part, len(self.hub_rows))
                (na, ma), (nb, mb) = self.parts(a), self.parts(b)
                ok, d = self.near(a, b, na + nb)
                ok &= (NUM * (na + nb) <= (NUM + DEN) * np.minimum(ma, mb)) & (a["node"] != b["node"]) & (a["packed"] >> (_POS + _N) <= b["packed"] >> (_POS + _N))
                d = np.where(ok, d, 1 << 20).reshape(len(part), -1)
                nearest = np.argsort(d, axis=1, kind="stable")[:, : self.best]
                at = np.repeat(np.arange(len(part)), nearest.shape[1])
                chosen = nearest.reshape(-1)
                good = d[at, chosen] < 1 << 20
                x, y = self.hub_rows[chosen[good]], part[at[good]]
                stars.append([x["node"], y["node"], d[at[good], chosen[good]], np.ones(len(y), bool), unsure(x, y), y["key"]])
                none = ~good.reshape(len(part), -1).any(1)
                marks.append(part[none])
        if ended:
            self.hub_key = None
        bare = np.concatenate(marks) if marks else rows[:0]
        out += [*stars, [bare["node"], bare["node"], np.full(len(bare), -1), np.ones(len(bare), bool), np.zeros(len(bare), bool), bare["key"]]]
        return wait, [np.concatenate([o[c] for o in out]) for c in range(6)]


class Groups:
    """Postings in order of group, those of a group in any order: what Meeting finds under each key. A group of any size passes: keys of over large postings are met, by hubs alone, as they come."""

    def __init__(self, large: int, hubs: int, best: int, most: int = ROWS):
        self.made, self.large, self.most = (large, hubs, best), large, most
        self.waiting, self.rows, self.bound, self.hot = [], 0, most, {}

    def by_key(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The waiting rows in order of key, and where each key's begin and how many they are."""
        rows = np.concatenate(self.waiting)
        rows = rows[np.argsort(rows["key"])]
        first = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]])
        return rows, first, np.diff(np.r_[first, len(rows)])

    def met(self, rows: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray):
        """What is found under those keys, each of which has, or had, over large postings."""
        for k in np.flatnonzero(which).tolist():
            key = int(rows["key"][first[k]])
            if key not in self.hot:
                self.hot[key] = Meeting(*self.made)
            yield self.hot[key].pairs(rows[first[k] : first[k] + size[k]], False)[1]

    def known(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return among(rows["key"][first], np.array(sorted(self.hot), np.int64))

    def add(self, rows: np.ndarray):
        self.waiting.append(rows)
        self.rows += len(rows)
        if self.rows > self.bound:
            rows, first, size = self.by_key()
            many = (size > self.large) | self.known(rows, first)
            yield from self.met(rows, first, size, many)
            self.waiting = [rows[np.repeat(~many, size)]]
            self.rows = len(self.waiting[0])
            self.bound = max(self.most, 2 * self.rows)

    def end(self):
        """The rest of a group."""
        if self.rows:
            rows, first, size = self.by_key()
            many = self.known(rows, first)
            yield from self.met(rows, first, size, many)
            rows = rows[np.repeat(~many & (size > 1), size)]  # nobody meets a key's only posting
            if len(rows):
                yield Meeting(*self.made).pairs(rows, True)[1]
        self.waiting, self.rows, self.bound, self.hot = [], 0, self.most, {}


def candidates(nodes: DataFrame, heavy: int, large: int, best: int, hubs: int = HUBS) -> DataFrame:
    """x, y, d, more, unsure, key: y's nearest candidates x under a key, whether y may have others there, and unsure(); x is null for the mark alone, the key without it."""

    def run(batches):
        now, groups = None, Groups(large, hubs, best)
        for batch in batches:
            for group, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if group != now:
                    for columns in groups.end():
                        yield from _found(*columns)
                    now = group
                for columns in groups.add(np.frombuffer(value.as_buffer(), ROW)):
                    yield from _found(*columns)
        for columns in groups.end():
            yield from _found(*columns)

    # about ten postings a node
    number = max(1, 10 * nodes.count() // GROUP)
    dealt = bundles(nodes, heavy, number).repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(tidy(run), "x long, y long, d int, more boolean, unsure boolean, key long")


class Asking:
    """Postings in order of key, those of asking nodes first: the best candidates of each of these among all of the key, in any number."""

    def __init__(self, best: int):
        self.best, self.key, self.asking, self.members = best, None, [], []

    def add(self, rows: np.ndarray, asking: np.ndarray) -> list[list[np.ndarray]]:
        """The columns x, y, d, more of the groups that end with these rows."""
        out = []
        first = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]]) if len(rows) else []
        for a, b in zip(first, [*first[1:], len(rows)], strict=True):
            part, asks = rows[a:b], asking[a:b]
            if part["key"][0] != self.key:
                out += self.end()
                self.key = part["key"][0]
            if asks.any():
                self.asking.append(part[asks])
            if self.asking:
                self.meet(part[~asks])
        return out

    def meet(self, members: np.ndarray) -> None:
        if len(self.asking) > 1 or not self.members:
            self.asking = [np.concatenate(self.asking)]
            old = self.members
            rows = len(self.asking[0])
            self.members = [np.full((rows, self.best + 1), 1 << 20), np.zeros((rows, self.best + 1), np.int64)]
            if old:
                for new, before in zip(self.members, old, strict=True):
                    new[: len(before)] = before
        ys, (ds, xs) = self.asking[0], self.members
        wide = max(1, ROWS // max(1, self.best))
        for i in range(0, len(ys), 1024):
            y = ys[i : i + 1024]
            for k in range(0, len(members), max(1, min(wide, PAIRS // len(y)))):
                x = members[k : k + max(1, min(wide, PAIRS // len(y)))]
                a, b = np.tile(x, len(y)), np.repeat(y, len(x))
                (na, ma), (nb, mb) = Meeting.parts(a), Meeting.parts(b)
                ok, d = Meeting.near(a, b, na + nb)
                ok &= (NUM * (na + nb) <= (NUM + DEN) * np.minimum(ma, mb)) & (a["node"] != b["node"]) & (a["packed"] >> (_POS + _N) <= b["packed"] >> (_POS + _N))
                all_d = np.concatenate([ds[i : i + 1024], np.where(ok, d, 1 << 20).reshape(len(y), -1)], axis=1)
                all_x = np.concatenate([xs[i : i + 1024], a["node"].reshape(len(y), -1)], axis=1)
                # one more than the best, to know of others
                chosen = np.argpartition(all_d, self.best, axis=1)[:, : self.best + 1]
                ds[i : i + 1024], xs[i : i + 1024] = np.take_along_axis(all_d, chosen, 1), np.take_along_axis(all_x, chosen, 1)

    def end(self) -> list[list[np.ndarray]]:
        out = []
        if self.members:
            ds, xs = self.members
            there = ds < 1 << 20
            more = np.repeat(there.sum(1) > self.best, self.best + 1).reshape(ds.shape)
            y = np.repeat(self.asking[0]["node"], self.best + 1).reshape(ds.shape)
            out = [[xs[there], y[there], ds[there], more[there]]]
        self.asking, self.members = [], []
        return out


def parted(asking: DataFrame, members: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """asking and members in one, with asking; of a key with over most asking nodes (counts: key, count) each part of them has a key of its own, with all members."""
    both = asking.withColumn("asking", F.lit(True)).unionByName(members.withColumn("asking", F.lit(False)))
    hot = counts.filter(F.col("count") > most).select("key", F.ceil(F.col("count") / most).alias("parts"))
    if hot.isEmpty():
        return both
    both = both.join(hot, "key", "left")
    part = F.when(F.col("asking"), F.array(F.pmod(F.xxhash64("node"), "parts"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    both = both.withColumn("part", F.explode(F.when(F.col("parts").isNotNull(), part).otherwise(F.array(F.lit(None).cast("long")))))
    return both.withColumn("key", F.when(F.col("part").isNotNull(), F.xxhash64("key", "part")).otherwise(F.col("key"))).drop("parts", "part")


def asked(posted: DataFrame, best: int) -> DataFrame:
    """candidates() of asking nodes alone; posted has asking, and every node's postings under their keys without it."""

    def run(batches):
        one = Asking(best)
        for batch in batches:
            part = np.empty(len(batch), ROW)
            for name in ROW.names:
                part[name] = batch.column(batch.schema.get_field_index(name)).to_numpy()
            for columns in one.add(part, batch.column(batch.schema.get_field_index("asking")).to_numpy(zero_copy_only=False)):
                yield from _found(*columns, np.ones(len(columns[0]), bool), columns[0])
        for columns in one.end():
            yield from _found(*columns, np.ones(len(columns[0]), bool), columns[0])

    dealt = posted.repartition("key").sortWithinPartitions("key", F.desc("asking"), "packed")
    return dealt.mapInArrow(tidy(run), "x long, y long, d int, more boolean, unsure boolean, key long")


def ordered(nodes: DataFrame) -> DataFrame:
    """nodes with coarse, 0 to 2047: never less for a later place. Numeric ids alone give more than one level."""
    if not isinstance(nodes.schema["doc_id"].dataType, T.NumericType):
        return nodes.withColumn("coarse", F.lit(0))
    least, most = nodes.agg(F.min("doc_id"), F.max("doc_id")).first()
    if least is None or least == most:
        return nodes.withColumn("coarse", F.lit(0))
    share = (F.col("doc_id").cast("double") - float(least)) / (float(most) - float(least))
    return nodes.withColumn("coarse", F.coalesce(F.floor(share * 2047), F.lit(0)).cast("int"))  # null ids come first


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", large: int = LARGE, heavy: int = HEAVY, best: int = BEST, hubs: int = HUBS, waiting: int = PAIRS) -> DataFrame:
    """doc_id, th (the text's xxhash64) and removed, the sorted line numbers from 0, of rows of docs that lose lines."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).filter("text IS NOT NULL")
    scratch, place = Scratch(docs.sparkSession), F.struct("doc_id", "th", "line")
    with lean(docs.sparkSession):
        known = levels(docs.select("text"), word_parts, BITS)
    # lines of a node meet at its name; those that a task has already put after another go anywhere
    parts = line_rows(docs, known, "prefix", heavy).withColumn("deal", F.when(F.col("node").isNull(), F.xxhash64("doc_id", "th", "line")))
    in_place = Window.partitionBy("node", "deal").orderBy("doc_id", "th", "line")
    parts = parts.withColumns({"first": F.col("node").isNotNull() & (F.row_number().over(in_place) == 1), "later": F.col("node").isNull() | (F.rank().over(in_place) > 1)})
    # rows equal in id and text are one document: neither first nor later
    lines = scratch.keep(parts.filter("first OR later").select("doc_id", "th", "line", "first", *[F.when(F.col("first"), F.col(c)).alias(c) for c in ("node", "n", "low", "high", "sign", "prefix")]))
    nodes = lines.filter("first").drop("first")
    with_order = ordered(nodes)
    found = scratch.keep(candidates(with_order, heavy, large, best, hubs))

    def ids_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()

    def whole_sets(pairs: DataFrame) -> DataFrame:
        """node and keys of the nodes of pairs, from the lines that first hold them."""
        held = nodes.select("node", "doc_id", "th", "line").join(ids_of(pairs), "node")
        held = scratch.keep(held.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("line").alias("wanted")))
        rows, numbers = held.agg(F.count("*"), F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()
        few = F.broadcast(held) if rows <= BROADCAST_DOCS and numbers <= BROADCAST_NUMBERS else held
        # null ids meet too; rows equal in id and text hold the same sets, of which one is enough
        texts = docs.join(few, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["th"] == F.col("_th")))
        return line_rows(texts, known, "keys").select("node", "keys").dropDuplicates(["node"])

    def directed(pairs: DataFrame) -> DataFrame:
        """The pairs (x, y, d, unsure) whose x is the earlier and whose signatures leave room for a match, with d, how far these differ. Pairs that aren't unsure are such."""
        open_ = pairs.filter("unsure").select("x", "y", "d")
        ends = scratch.keep(nodes.select("node", place.alias("order"), "n", "sign").join(ids_of(open_), "node"))
        a, b = (ends.select(F.col("node").alias(c), F.col("n").alias(f"{c}n"), F.col("sign").alias(f"{c}s"), F.col("order").alias(f"{c}o")) for c in "xy")
        joined = open_.join(a, "x").join(b, "y").filter("xo < yo").withColumn("d", F.when(F.col("xs").isNotNull() & F.col("ys").isNotNull(), differing("xs", "ys")).otherwise(F.col("d")))
        return scratch.keep(joined.filter(F.col("d") <= room(F.col("xn"), F.col("yn"))).select("x", "y", "d").unionByName(pairs.filter("NOT unsure").select("x", "y", "d")))

    def matched(pairs: DataFrame) -> DataFrame:
        return scratch.keep(similar(pairs, whole_sets(pairs)).select(F.col("y").alias("node")).distinct())

    def later(pairs: DataFrame, few: bool = False) -> DataFrame:
        """node of the later one of each matching pair: first each node's nearest pair is verified, then all others of nodes still open; all at once if few or if most nodes have one."""
        open_ = directed(pairs)
        if not few:
            all_, of = open_.agg(F.count("*"), F.approx_count_distinct("y")).first()
            few = all_ <= 2 * of
        if few:
            return matched(open_.select("x", "y").distinct())
        nearest = scratch.keep(open_.groupBy("y").agg(F.min_by("x", F.struct("d", "x")).alias("x")).select("x", "y"))
        sure = matched(nearest)
        rest = scratch.keep(open_.select("x", "y").distinct().join(sure.withColumnRenamed("node", "y"), "y", "left_anti").join(nearest, ["x", "y"], "left_anti"))
        return sure if rest.isEmpty() else sure.unionByName(matched(rest))

    # under its other keys a node has been given all
    marked = scratch.keep(found.filter("more").select(F.col("y").alias("node"), "key").distinct())
    gone, relevant = later(found.filter("x IS NOT NULL")), None
    while True:
        # more candidates of the marked nodes that nothing has settled, until no more are left
        still = scratch.keep(found.filter("more").select(F.col("y").alias("node")).distinct().join(gone, "node", "left_anti"))
        if still.isEmpty():
            break
        here = marked.join(still, "node", "left_semi")
        asking = scratch.keep(postings(with_order.join(still, "node", "left_semi"), heavy).join(here, ["node", "key"], "left_semi"))
        counts = scratch.keep(asking.groupBy("key").count())
        # the fewer ask, the more each of them gets
        best = max(8 * best, ASKED // max(1, asking.count()))
        if relevant is None:  # later rounds ask under some of the same keys; the others' postings meet nobody
            only = few_numbers(counts, "key")
            relevant = postings(with_order, heavy, only)
            relevant = relevant if only is None else scratch.keep(relevant)
        found = scratch.keep(asked(parted(asking, relevant, counts, max(1, waiting // best)), best))
        gone = gone.unionByName(later(found, few=True))

    firsts = nodes.select("node", "doc_id", "th", "line").join(gone.distinct(), "node", "left_semi")
    fate = scratch.keep(lines.filter("NOT first").select("doc_id", "th", "line").unionByName(firsts.drop("node")))
    scratch.drop(*(df for _, df in [*scratch.paths.values()] if df is not fate))
    return fate.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text less the removed lines, and n_removed; a column of that name gives way, all others stay.

    Null texts stay null; a text all of whose lines go is empty.
    """
    docs = without(docs, ["n_removed"])
    i, h, r = fresh(docs, "id_of", "hash_of", "lines_of")
    removed = removed_lines(docs, doc_id, text).select(F.col("doc_id").alias(i), F.col("th").alias(h), F.col("removed").alias(r))
    joined = docs.join(removed, F.col(f"`{doc_id}`").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(h)), "left")

    def factory():
        def compute(batch):
            texts, gone = (batch.column(batch.schema.get_field_index(c)) for c in (text, r))
            kept = []
            for t, lines in zip(texts, gone, strict=True):
                if lines.is_valid:
                    lost = set(lines.as_py())
                    kept.append("\n".join(x for k, x in enumerate(t.as_py().split("\n")) if k not in lost))
                else:
                    kept.append(t.as_py())
            return [kept, pa.array([len(x) if x.is_valid else 0 for x in gone], pa.int32())]

        return compute

    return append_columns(joined, [(text, "string"), ("n_removed", "int")], factory).select(*[F.col(f"`{c}`") for c in docs.columns], "n_removed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed = removed_lines(docs).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "removed")
    slim = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    out = slim.join(removed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_th")), "left")
    line_list = F.concat_ws(",", F.col("removed").cast("array<string>"))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(line_list, F.lit("")).alias("removed_lines"))


#: Every pair of word sets that share a word; the later one of a match goes.
SQL = r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, i - 1 AS line, list_sort(list_distinct(regexp_extract_all(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS w
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
f AS MATERIALIZED (
  SELECT w, arg_min(doc_id, (doc_id, line)) AS doc_id, min((doc_id, line)) AS pos, row_number() OVER () AS node FROM l WHERE len(w) > 0 GROUP BY w),
t AS MATERIALIZED (SELECT node, len(w) AS n, unnest(w) AS t FROM f),
c AS MATERIALIZED (SELECT t, count(*) AS k FROM t GROUP BY t),
r AS MATERIALIZED (SELECT node, n, t.t, row_number() OVER (PARTITION BY node ORDER BY k, t.t) AS p FROM t JOIN c ON t.t = c.t),
pre AS MATERIALIZED (SELECT node, n, t FROM r WHERE p <= n - ceil(n * 80 / 100.0) + 1),
cand AS MATERIALIZED (SELECT DISTINCT a.node AS x, b.node AS y FROM pre a JOIN pre b ON a.t = b.t AND a.node <> b.node AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
gone AS MATERIALIZED (
  SELECT DISTINCT y AS node FROM cand JOIN f a ON a.node = x JOIN f b ON b.node = y
  WHERE a.pos < b.pos AND 100 * len(list_intersect(a.w, b.w)) >= 80 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
rem AS (
  SELECT l.doc_id, l.line FROM l JOIN f ON l.w = f.w LEFT JOIN gone USING (node) WHERE gone.node IS NOT NULL OR f.pos <> (l.doc_id, l.line)),
q AS (SELECT doc_id, count(*) AS k, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS s FROM rem GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_removed, coalesce(s, '') AS removed_lines
FROM documents d LEFT JOIN q USING (doc_id)
"""
