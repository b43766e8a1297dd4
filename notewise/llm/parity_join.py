"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles (three words; with fewer words the whole
sequence is one; without words the set is empty and links with nothing). Two documents link
when 100 * intersection >= 90 * union, so their symmetric difference is at most a nineteenth
of the sum of their sizes.

Sketch: every shingle flips one bit, so the Hamming distance of two sketches is at most the
symmetric difference. Documents are put into size bands; the sketch of a band is cut into
more parts than that difference can touch, so linked documents agree on some part whole, and
with ``spare`` more parts they agree on more than ``spare``. A document joins on its parts in
its own band and, when its partner may be in the band below, in that one too.

Parts that say little are left out without losing a link. A set agrees with a linked one on all
parts but as many as the two may differ in, so on ``need`` parts at least that are not empty,
``need`` being what its size and its empty parts leave of them. A document with too many empty parts is cut into parts anew by another hash, up to ``LEVELS`` times. Every set
leaves out its most frequent parts, three quarters of ``need``, and more of them while they are
heavy, up to all of ``need`` but one. As the order of parts is the
same for all sets, what either of a pair leaves out are the most frequent parts they agree on, so
the pair still agrees on ``need`` less the larger of the two numbers. Parts that more than
``LIGHT`` sets share are heavy.

Candidates: sets that agree on light parts are counted pair by pair (at most ``LIGHT`` partners
for a set and part), and a pair is a candidate only when it agrees on as many as a link would
leave. So two texts that share a passage and agree on a few parts by chance are none, and a set
that has fewer light parts left is not even paired. Nor are two sets that meet on a part but cannot
agree on enough of them: every shared part tells into which of 64 cells the other sets with it fall,
and a set meets only sets of cells that are on as many of its parts as a link needs. A linked set is
on that many, so its cell is always among them; sets that share one or two parts with very many
others make no pairs. Sets that have heavy parts left are joined
to the smallest set of each, a star per part: two linked sets share such a part, or agree on
light ones alone. One exchange by set and one by key carry both: pairs and stars come from the same pass.

Scale: documents with the same set are one member (kept once per task before any shuffle,
then once overall). Part keys are dealt out by key, sorted and read as a stream, so a key that
very many sets share is never held at once. Connected components of candidates and stars are
clusters, verified on the exact sets: a small cluster in one task; a large one (a family of very
many copies) is cut by size (linked sets differ by a tenth at most) and then into
blocks of bounded size, and a task compares two blocks: Hamming distances of whole sketches
first, exact sets for every pair that is left, and it returns each member's number of links
and edges that connect the linked members, two rows a member at most. So a family of copies,
however large, is shared out among tasks, and no row is made per pair of a family.

Sets are 64-bit shingle hashes; members are identified by a 64-bit hash of their set.
Null text has no words. Rows with a null doc_id take part and never name a component unless
all its rows are null. Repeated rows give one row each. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, lean, materialise
from .components import connected_components, smallest_reached
from .words import find_words, mix, texts_of, windows

SHINGLE = 3
PERCENT = 90
PART_BITS = 128
#: Bits of a part's key. Keys that are equal by chance only add candidates, and the shuffles of parts,
#: the largest of this operator, hold as many random bits less; the zeros come first in a row's bytes.
#: Later the number of the key's sets is in their place.
_KEY_BITS = np.uint64(2 ** 64 - 2 ** 24)
_OFTEN = (1 << 24) - 1
BAND = 1.5
#: A key shared by more sets than this is heavy: a set and key give half as many pairs at most.
LIGHT = 64
#: How often a document with too many empty parts is cut into parts anew.
LEVELS = 4
#: Digests of members up to this many (8 bytes each) are broadcast to skip all other texts
#: before the shuffle; beyond, all texts are shuffled.
BROADCAST_IDS = 1 << 20
#: What one side of a comparison task holds at most: members, and shingles of all of them.
BLOCK_MEMBERS = 512
BLOCK_GRAMS = 1 << 20
#: Shingles of one matrix product.
_SLICE = 1 << 13
#: Pairs that a task holds before it adds up equal ones.
_PAIRS = 1 << 19


def _digest() -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64("text")


@lru_cache(maxsize=4)
def bands(percent: int = PERCENT, largest: int = 1 << 31) -> list[tuple[int, int, int, int]]:
    """(first size, last size, parts, spare parts) of each band.

    A pair belongs to the band of its smaller set of size a; the larger one has at most
    100 a / percent, and the pair differs in at most (a + b)(100 - percent) / (100 + percent).
    """
    out, lo = [], 1
    while lo <= largest:
        hi = max(lo, int(lo * BAND) - 1)
        differ = (hi + hi * 100 // percent) * (100 - percent) // (100 + percent)
        spare = max(1, differ // 2) if differ else 0
        out.append((lo, hi, differ + 1 + spare if differ else 0, spare))
        lo = hi + 1
    return out


def _bands_of(n: int, percent: int) -> list[int]:
    """The bands in which a set of size n takes part."""
    table = bands(percent)
    starts = _starts(percent)
    own = int(np.searchsorted(starts, n, "right")) - 1
    out, j = [own], own - 1
    while j >= 0 and table[j][1] * 100 // percent >= n:  # a smaller partner may be there
        out.append(j)
        j -= 1
    return [j for j in out if table[j][2]]


@lru_cache(maxsize=4)
def _ends(percent: int) -> np.ndarray:
    return np.array([b[1] for b in bands(percent)])


@lru_cache(maxsize=4)
def _starts(percent: int) -> np.ndarray:
    return np.array([b[0] for b in bands(percent)])


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The set of a document's shingle hashes, sorted."""
    n = len(words)
    return np.unique(windows(words, size if n >= size else n)) if n else np.zeros(0, np.uint64)


def signature(found: np.ndarray) -> int:
    """64-bit identity of a set."""
    with np.errstate(over="ignore"):
        total = np.uint64(mix(found, 1).sum(dtype=np.uint64)) ^ np.uint64(len(found))
        return int(mix(np.array([total ^ np.bitwise_xor.reduce(mix(found, 2))], np.uint64))[0].astype(np.int64))


def _differ(size, place, percent: int):
    """By how many shingles a set of this size and a linked one of the place's band differ at most."""
    own = np.searchsorted(_starts(percent), size, "right") - 1 == place // LEVELS
    partner = np.where(own, size * 100 // percent, _ends(percent)[place // LEVELS])
    return (size + partner) * (100 - percent) // (100 + percent)


def part_keys(found: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every part that a set uses: join key (a hash of band, level, part and bits), place (band
    and level), and need: how many light parts at least a linked set agrees on there, when
    this one has no heavy parts (0: it may agree on none)."""
    keys, places, needs = [], [], []
    for j in _bands_of(len(found), percent):
        parts = bands(percent)[j][2]
        for level in range(LEVELS):
            h = mix(found, 100 + j + 1000 * level)
            part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cell = (part * np.uint64(PART_BITS) + (h & np.uint64(PART_BITS - 1))).astype(np.int64)
            used = np.bincount(part.astype(np.int64), minlength=parts) > 0
            bits = (np.bincount(cell, minlength=parts * PART_BITS) & 1).astype(np.uint8).reshape(parts, PART_BITS)
            sketch = np.packbits(bits, axis=1).view(np.uint64)
            label = np.arange(parts, dtype=np.uint64) + np.uint64((j * LEVELS + level) << 40)
            key = mix(sketch[:, 0] ^ mix(sketch[:, 1] ^ mix(label, 3), 4), 5) & _KEY_BITS
            distinct = len(np.unique(key[used]))  # equal keys of a set are counted once
            need = max(0, distinct - int(_differ(len(found), j * LEVELS + level, percent)))
            if need or level < LEVELS - 1:
                key = key[used]
            keys.append(key)
            places.append(np.full(len(key), j * LEVELS + level))
            needs.append(np.full(len(key), need))
            if need:
                break
    if not keys:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
    return np.concatenate(keys), np.concatenate(places), np.concatenate(needs)


def _sets(batches, lower: bool, size: int):
    """Per slice of a batch: its rows, and each row's set of shingles. Sets, parts and members of
    a whole batch take many times its memory."""
    for batch in batches:
        for row, end, data, offsets in texts_of(batch):
            words, _, _, at = find_words(data, offsets, lower)
            yield batch.slice(row, end - row), [shingles(words[a:b], size) for a, b in zip(at[:-1], at[1:], strict=True)]


def _describe(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, digest (of the text), n, sig of every row."""

    def run(batches):
        for batch, found in _sets(batches, True, size):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([signature(f) for f in found], pa.int64())], names=["doc_id", "digest", "n", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _digest().alias("digest")).mapInArrow(lean(run), f"doc_id {kind}, digest long, n long, sig long")


_MOST = (1 << 12) - 1


def _info(size, need, spared, place):
    """Size of a set and, in one place, its need (at most _MOST), the number of parts it has left
    out, and the place, in one number."""
    return (np.int64(size) << 32) + (need << 20) + (np.int64(spared) << 8) + place


def _parts(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """key, sig, info of every part; a set comes once per task."""

    def run(batches):
        seen: set[int] = set()
        for _, found in _sets(batches, True, size):
            out = [[], [], []]
            for f in found:
                sig = signature(f)
                if len(f) and sig not in seen:
                    seen.add(sig)
                    key, place, need = part_keys(f, percent)
                    out[0].append(key.view(np.int64))
                    out[1].append(np.full(len(key), sig))
                    out[2].append(_info(len(f), np.minimum(need, _MOST), 0, place))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["key", "sig", "info"])

    return docs.select("text").mapInArrow(lean(run), "key long, sig long, info long")


#: In place of info: the key is heavy, also when few sets are left of it.
HEAVY = -1
_MET = "a long, b long, place int, need int, n long"


def _added(pairs: list[tuple]) -> pa.RecordBatch:
    """Equal pairs (a, b, place, need) with their number."""
    a, b, place, need = (np.concatenate(c) for c in zip(*pairs, strict=True))
    order = np.lexsort((place, b, a))
    a, b, place = a[order], b[order], place[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(new)
    columns = (a[at], b[at], place[at], need[order][at], np.diff(np.append(at, len(a))))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 2, *[pa.int32()] * 2, pa.int64()), strict=True)],
                                      names=["a", "b", "place", "need", "n"])


def _agreeing(key: np.ndarray, sig: np.ndarray, info: np.ndarray, partners: np.ndarray, percent: int, light: int) -> tuple[np.ndarray, ...]:
    """a < b, place and needed number of light parts of all pairs within groups of equal keys that
    are in each other's partners and whose sizes may link."""
    size, need, spared, place = info >> 32, (info >> 20) & _MOST, (info >> 8) & _MOST, info & 0xFF
    cell, partners = _cell(sig), partners.view(np.uint64)
    left, right = [], []
    for step in range(1, light):
        at = np.flatnonzero(key[step:] == key[:len(key) - step])
        if not len(at):
            break
        at = at[((partners[at] >> cell[at + step]) & (partners[at + step] >> cell[at]) & np.uint64(1)) > 0]
        left.append(at)
        right.append(at + step)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    # Only in the smaller one's band, and only where one of the two may leave out its empty parts.
    good = (place[i] == place[j]) & (100 * small >= percent * large)
    good &= np.searchsorted(_starts(percent), small, "right") - 1 == place[i] // LEVELS
    good &= (need[i] > 0) | (need[j] > 0) | (place[i] % LEVELS == LEVELS - 1)
    i, j = i[good], j[good]  # rows of a group are sorted by sig
    # The bound of each, with the pair's own sizes in place of the largest partner's.
    differ = (size[i] + size[j]) * (100 - percent) // (100 + percent)
    bound = [need[k] + np.where(need[k] > 0, np.maximum(0, _differ(size[k], place[k], percent) - differ), 0) for k in (i, j)]
    return sig[i], sig[j], place[i], np.maximum(1, np.maximum(*bound) - np.maximum(spared[i], spared[j]))


def _by_key(batches, light: int):
    """Rows (key, sig, info and further numbers) sorted by key and sig, as a stream of (rows, sizes):
    whole groups of 2 to ``light`` sets with the size of each row's group, and rows of larger groups,
    and of keys marked heavy (info HEAVY), with size 0."""
    held, hot = None, None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            more = np.array([c.to_numpy() for c in batch.columns], np.int64)
            held = more if held is None else np.concatenate([held, more], axis=1)
        if held is None:
            return
        if batch is not None:
            new = np.ones(held.shape[1], bool)  # a set met by several tasks is one
            new[1:] = (held[0, 1:] != held[0, :-1]) | (held[1, 1:] != held[1, :-1])
            held = held[:, new]
        if hot is not None and held.shape[1]:  # more of a key whose first rows have been returned
            other = np.flatnonzero(held[0] != hot[0])
            more = int(other[0]) if len(other) else held.shape[1]
            rest = held[:, :more][:, held[1, :more] != hot[1]]
            if rest.shape[1]:
                yield rest, np.zeros(rest.shape[1], np.int64)
                hot = (hot[0], rest[1, -1])
            held = held[:, more:]
            if held.shape[1]:
                hot = None
        if not held.shape[1]:
            continue
        starts = np.flatnonzero(np.append(True, held[0, 1:] != held[0, :-1]))
        sizes = np.diff(np.append(starts, held.shape[1]))
        cut = held.shape[1]
        if batch is not None and sizes[-1] <= light:  # the last key may go on
            cut, sizes = starts[-1], sizes[:-1]
        elif batch is not None:
            hot = (held[0, -1], held[1, -1])
        size = np.repeat(sizes, sizes)
        heavy = (size > light) | (held[2, :cut] == HEAVY)
        shared = heavy | (size > 1)
        if shared.any():
            yield held[:, :cut][:, shared], np.where(heavy, 0, size)[shared]
        held = held[:, cut:]


def _cell(sig: np.ndarray) -> np.ndarray:
    """One of 64 cells for each set: sets sorted by sig are sorted by cell."""
    return ((sig >> 58) & 63).astype(np.uint64)


def _mates(key: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Of rows sorted by key and sig: the cells of the other sets of each row's key, as bits."""
    cell = _cell(sig)
    bit = np.uint64(1) << cell
    begins = np.append(True, key[1:] != key[:-1])
    every = np.bitwise_or.reduceat(bit, np.flatnonzero(begins))[np.cumsum(begins) - 1]
    next_alike = np.append(~begins[1:] & (cell[1:] == cell[:-1]), False)
    alike = next_alike | np.append(False, next_alike[:-1])  # another set of the key is in the own cell
    return np.where(alike, every, every & ~bit).view(np.int64)


def _may_link(key: np.ndarray, info: np.ndarray, percent: int) -> np.ndarray:
    """Of rows in groups of equal keys: whether another set of the key has a size that may link with
    the row's, the smaller of the two being in the place's band."""
    size, last = info >> 32, _ends(percent)[(info & 0xFF) // LEVELS]
    order = np.lexsort((size, key))
    key, size, last = key[order], size[order], last[order]
    own = size <= last  # the size is in the band; larger ones link with these only
    at = np.arange(len(key))
    below = np.append(-1, np.maximum.accumulate(np.where(own, at, -1))[:-1])
    good = (below >= 0) & (key[below] == key) & (100 * size[below] >= percent * size)
    good[:-1] |= own[:-1] & (key[1:] == key[:-1]) & (100 * size[:-1] >= percent * size[1:])
    out = np.empty(len(key), bool)
    out[order] = good
    return out


def _shared(percent: int, light: int):
    """(sig, key, info, mates) of the keys that several sets share. The number of sets, or ``light`` + 1
    when there are more, is in the key's low bits; mates are the cells of the key's other sets (0 when
    there are more). Sets that link with none of the key's others, by their sizes, are left out."""

    def run(batches):
        for (key, sig, info), size in _by_key(batches, light):
            stay = (size == 0) | _may_link(key, info, percent)
            key, sig, info, size = key[stay], sig[stay], info[stay], size[stay]
            if len(key):
                columns = (sig, key | np.where(size, size, light + 1), info, np.where(size, _mates(key, sig), 0))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["sig", "key", "info", "mates"])

    return run


def _partners(rows: pa.Table) -> pa.Table:
    """Of a set's rows (key, sig, info, mates, least) in one place, heavy ones with info HEAVY: (key,
    sig, info, partners) of the heavy rows (partners 0) and of the light ones that its partners may
    share. Partners are the cells that are on at least ``least`` of its light rows; a linked set that
    shares no heavy row is on as many."""
    info, mates = (rows.column(c).to_numpy() for c in ("info", "mates"))
    bits = np.unpackbits(np.ascontiguousarray(mates).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    enough = bits.sum(axis=0, dtype=np.int64) >= max(1, rows.column("least")[0].as_py())
    cells = np.packbits(enough, bitorder="little").view(np.int64)[0]
    heavy = info == HEAVY
    return (rows.select(["key", "sig", "info"]).append_column("partners", pa.array(np.where(heavy, 0, cells), pa.int64()))
            .filter(pa.array(heavy | ((mates & cells) != 0))))


def _star(key: np.ndarray, sig: np.ndarray, last: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key and sig: each row's set and the smallest set of its key; ``last`` is the
    key before and its smallest set."""
    first = np.append(True, key[1:] != key[:-1])
    lowest = sig[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
    return sig, np.where(key == last[0], last[1], lowest) if last else lowest


def _meet(percent: int, light: int):
    """Pairs of sets (a, b) in a place, with the number of light keys that they agree on and how many
    they need; and of heavy keys every set with the smallest one (place -1, need 1). Rows are (key,
    sig, info, partners); without the last, every set may be a partner."""

    def run(batches):
        pairs, n_pairs, last = [], 0, ()
        for rows, sizes in _by_key(batches, light):
            star = sizes == 0  # light keys: no group is larger
            if star.any():
                sig, lowest = _star(rows[0, star], rows[1, star], last)
                last = (rows[0, star][-1], lowest[-1])
                other = sig != lowest
                pairs.append((sig[other], lowest[other], np.full(other.sum(), -1), np.ones(other.sum(), np.int64)))
                n_pairs += len(pairs[-1][0])
            if not star.all():
                lit = rows[:, ~star]
                pairs.append(_agreeing(*lit[:3], lit[3] if len(lit) > 3 else np.full(lit.shape[1], -1), percent, light))
                n_pairs += len(pairs[-1][0])
            if n_pairs > _PAIRS:
                yield _added(pairs)
                pairs, n_pairs = [], 0
        if n_pairs:
            yield _added(pairs)

    return run


def _candidates(docs: DataFrame, size: int, percent: int, light: int = LIGHT) -> DataFrame:
    """Edges (u, v) that connect all sets that may link (and some that do not)."""
    dealt = lambda rows: rows.repartition("key").sortWithinPartitions("key", "sig")
    shared = dealt(_parts(docs, size, percent)).mapInArrow(lean(_shared(percent, light)), "sig long, key long, info long, mates long")
    # A set leaves out its most frequent parts: three quarters of as many as it may, and of heavy ones
    # all that it may. What is left of a linked pair's agreement is need less these.
    own = Window.partitionBy("sig", "place")
    may = F.col("need") - 1
    ranked = (shared.repartition("sig")
              .withColumns({"place": F.col("info").bitwiseAND(0xFF), "need": F.shiftright("info", 20).bitwiseAND(_MOST),
                            "often": F.col("key").bitwiseAND(_OFTEN)})
              .withColumn("heavy", F.col("often") > light)
              .withColumns({"turn": F.row_number().over(own.orderBy(F.col("often").desc(), "key")), "hot": F.count_if("heavy").over(own),
                            "have": F.count(F.lit(1)).over(own)})
              .withColumn("spared", F.greatest(F.lit(0), F.least(may, F.greatest(F.floor(may * 3 / 4), "hot"))).cast("long"))
              .where(F.col("turn") > F.col("spared")))
    # Light parts matter only to a set that has as many as any link would leave.
    light_left = F.col("have") - F.greatest("hot", "spared")
    least = F.col("need") - F.col("spared")
    info = F.when(F.col("heavy"), F.lit(HEAVY)).otherwise(F.col("info") + F.shiftleft("spared", 8))
    kept = (ranked.where(F.col("heavy") | (light_left >= least)).select("key", "sig", info.alias("info"), "place", "mates", least.alias("least"))
            .groupBy("sig", "place").applyInArrow(_partners, "key long, sig long, info long, partners long"))
    # Heavy parts that are left: a star to the smallest set of each. Light ones: pairs that agree on
    # enough of them. Both from one pass, as every reader of ``kept`` would make the exchanges anew.
    met = dealt(kept).mapInArrow(lean(_meet(percent, light)), _MET)
    return (met.groupBy("a", "b", "place").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need")
            .select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())


def _common(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of ``rows`` with ``cols`` (numbers of sets), by products
    of 0/1 matrices over slices of the shingles that several of the sets have."""
    both = np.zeros((len(rows), len(cols)), np.float32)
    used = np.union1d(rows, cols)
    owner = np.repeat(used, [len(sets[i]) for i in used])
    flat, place, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[place] > 1)
    owner, place = owner[several], (np.cumsum(count > 1) - 1)[place[several]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    at_row, at_col = np.full(len(sets), -1), np.full(len(sets), -1)
    at_row[rows], at_col[cols] = np.arange(len(rows)), np.arange(len(cols))
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, _SLICE):
        mine = slice(*np.searchsorted(place, [lo, lo + _SLICE]))
        sides = []
        for at, size in ((at_row, len(rows)), (at_col, len(cols))):
            own = at[owner[mine]]
            side = np.zeros((size, _SLICE), np.float32)
            side[own[own >= 0], place[mine][own >= 0] - lo] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    return both


def linked_pairs(sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of the sets, or of those of side 0 with those of side 1.

    The Hamming distance of parity sketches comes first: beyond the difference that a link
    allows, the pair cannot link. The rest is verified on the exact sets, pair by pair when
    few pairs are left and by matrix products otherwise.
    """
    rows = np.arange(len(sets)) if side is None else np.flatnonzero(side == 0)
    cols = rows if side is None else np.flatnonzero(side == 1)
    none = np.zeros(0, np.int64)
    if not len(rows) or not len(cols):
        return none, none
    n = np.array([len(f) for f in sets])
    bits = min(1 << 14, max(512, 1 << int(2 * n.max()).bit_length()))
    signs = np.empty((len(sets), bits), np.float32)
    for i, f in enumerate(sets):
        signs[i] = 1 - 2 * (np.bincount((mix(f, 9) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1)
    distance = (bits - signs[rows] @ signs[cols].T) / 2
    allowed = (n[rows][:, None] + n[cols][None, :]) * (100 - percent) // (100 + percent)
    near = distance <= allowed
    left, right = np.nonzero(np.triu(near, 1) if side is None else near)
    left, right = rows[left], cols[right]
    if len(left) <= 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                         for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    else:
        a, b = np.unique(left), np.unique(right)
        both = _common(sets, a, b)[np.searchsorted(a, left), np.searchsorted(b, right)].astype(np.int64)
    good = both * (100 + percent) >= (n[left] + n[right]) * percent
    return left[good], right[good]


def _links(docs: DataFrame, candidates: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the verified links: edges (u, v) enough to join all members that links connect, and
    rows (u, null, rows) that add up to the number of rows that u's set links with.

    ``candidates`` are edges (u, v); ``classes`` is (sig, least, n, copies), copies being the number
    of rows with the set.
    """
    clusters = connected_components(candidates).select(F.col("node").alias("c_sig"), F.col("component").alias("cluster"))
    members = classes.select("sig", F.col("least.doc_id").alias("doc_id"), F.col("least.digest").alias("digest"), "n", "copies")
    # Size classes: linked sets are in the same class or in neighbouring ones.
    step = math.log(100 / percent) * 1.001
    found = (members.join(clusters, F.col("sig") == F.col("c_sig"))
             .select("sig", "doc_id", "digest", "n", "copies", "cluster", F.floor(F.log("n") / F.lit(step)).alias("class")))
    total = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("c_n"), F.sum("n").alias("c_grams")).select(
        F.col("cluster").alias("t_cluster"), ((F.col("c_n") <= BLOCK_MEMBERS) & (F.col("c_grams") <= BLOCK_GRAMS)).alias("small"))
    found = materialise(found.join(total, F.col("cluster") == F.col("t_cluster"))
                        .withColumn("class", F.when(F.col("small"), F.lit(0)).otherwise(F.col("class")))
                        .select("sig", "doc_id", "digest", "cluster", "class", "n", "copies"))
    blocks = found.groupBy("cluster", "class").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_MEMBERS)), F.ceil(F.sum("n") / F.lit(BLOCK_GRAMS))).alias("blocks"))
    near = lambda k, name: blocks.select(F.col("cluster").alias(f"{name}_c"), (F.col("class") - k).alias(f"{name}_k"),
                                         F.col("blocks").alias(name))
    grid = blocks
    for k, name in ((1, "above"), (-1, "below")):
        grid = grid.join(near(k, name), (F.col("cluster") == F.col(f"{name}_c")) & (F.col("class") == F.col(f"{name}_k")), "left")
    grid = grid.select(F.col("cluster").alias("g_c"), F.col("class").alias("g_k"), "blocks", "above", "below")
    wanted = (found.join(grid, (F.col("cluster") == F.col("g_c")) & (F.col("class") == F.col("g_k")))
              .select("sig", F.col("doc_id").alias("m_id"), F.col("digest").alias("m_digest"), "copies", "cluster", "class", "blocks", "above", "below"))

    def sets(batches):
        seen: set[int] = set()
        for batch, grams in _sets(batches, True, size):
            new = []  # rows that repeat are the same member
            for k, sig in enumerate(batch.column("sig").to_pylist()):
                if sig not in seen:
                    seen.add(sig)
                    new.append(k)
            batch, grams = batch.take(pa.array(new, pa.int64())), [grams[k] for k in new]
            same = pa.array([signature(f) for f in grams], pa.int64())
            columns = [batch.column(c) for c in ("sig", "copies", "cluster", "class", "blocks", "above", "below")]
            yield pa.RecordBatch.from_arrays(
                [*columns, same, pa.array([f.view(np.int64) for f in grams], pa.list_(pa.int64()))],
                names=["sig", "copies", "cluster", "class", "blocks", "above", "below", "same", "grams"])

    texts = docs.select("doc_id", _digest().alias("digest"), "text")
    if found.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(found.select("digest").distinct()), "digest", "left_semi")
    # The digest is in the key: rows that share a doc_id (or have none) are spread.
    same_row = (F.col("digest") == F.col("m_digest")) & F.col("doc_id").eqNullSafe(F.col("m_id"))
    texts = texts.join(wanted.hint("shuffle_hash"), same_row).drop("doc_id", "m_id", "digest", "m_digest")
    rows = texts.mapInArrow(lean(sets), "sig long, copies long, cluster long, class long, blocks long, above long, below long, "
                                  "same long, grams array<long>").where("sig = same")
    block = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    level = F.col("class")
    upto = lambda name: F.when(F.col(name) > 0, F.sequence(F.lit(0).cast("long"), F.col(name) - 1)).otherwise(
        F.array().cast("array<long>"))
    task = lambda a, i, b, j: F.struct(a.alias("a"), i.alias("i"), b.alias("b"), j.alias("j"))
    tasks = F.concat(
        F.transform(upto("blocks"), lambda j: task(level, F.least(block, j), level, F.greatest(block, j))),
        F.transform(upto("above"), lambda j: task(level, block, level + 1, j)),
        F.transform(upto("below"), lambda j: task(level - 1, j, level, block)))

    def compare(group: pa.Table) -> pa.Table:
        """A task of two blocks counts the pairs between them, that of one block those inside."""
        grams = group.column("grams").combine_chunks()
        sigs, at = np.unique(group.column("sig").to_numpy(), return_index=True)  # a repeated row is the same member
        flat, ends = grams.flatten().to_numpy().view(np.uint64), grams.offsets.to_numpy() - grams.offsets[0].as_py()
        a, i, b, j = (group.column(c)[0].as_py() for c in ("a", "i", "b", "j"))
        own = group.column("first").to_numpy(zero_copy_only=False)[at]
        side = None if (a, i) == (b, j) else np.where(own, 0, 1)
        left, right = linked_pairs([flat[ends[k]:ends[k + 1]] for k in at.tolist()], side, percent)
        copies = group.column("copies").to_numpy()[at]
        met = np.zeros(len(sigs), np.int64)
        np.add.at(met, left, copies[right])
        np.add.at(met, right, copies[left])
        least = smallest_reached(len(sigs), left, right)
        linked, joined = np.flatnonzero(met), np.flatnonzero(least != np.arange(len(sigs)))
        return pa.table({"u": pa.array(np.append(sigs[joined], sigs[linked]), pa.int64()),
                         "v": pa.array([*sigs[least[joined]].tolist(), *[None] * len(linked)], pa.int64()),
                         "rows": pa.array([*[None] * len(joined), *met[linked].tolist()], pa.int64())})

    first = (F.col("task.a") == F.col("class")) & (F.col("task.i") == block)
    return (rows.select("sig", "copies", "grams", "cluster", "class", "blocks", F.explode(tasks).alias("task"))
            .select("sig", "copies", "grams", "cluster", "task.*", first.alias("first"))
            .groupBy("cluster", "a", "i", "b", "j").applyInArrow(compare, "u long, v long, rows long"))


def _sets_with_components(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The described rows; and per set that is not empty: sig, component, doc_id, n_links (of
    each row with the set) and ``least``, the row (null, doc_id, digest) of the set that comes first."""
    described = materialise(_describe(docs, size))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    classes = (described.where("n > 0").groupBy("sig").agg(least.alias("least"), F.max("n").alias("n"),
                                                              F.count(F.lit(1)).alias("copies"))
               .select("sig", F.col("least.doc_id").alias("doc_id"), "n", "copies", "least"))
    links = materialise(_links(docs, _candidates(docs, size, percent), classes, size, percent))
    joined = connected_components(links.where("v is not null").select("u", "v")).select(
        F.col("node").alias("sig"), "component")
    met = links.where("v is null").groupBy(F.col("u").alias("sig")).agg(F.sum("rows").alias("met"))
    return described, (classes.join(joined, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
                       .join(met, "sig", "left")
                       .withColumn("n_links", F.col("copies") - 1 + F.coalesce("met", F.lit(0))).drop("met", "copies"))


def components_and_links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (how many other rows link with the row; rows
    with the same set do) for every row of ``docs``."""
    described, named = _sets_with_components(docs, size, percent)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # A key of its own makes the join shuffle both sides, so that a hot set can be split.
    of_set = named.join(smallest, "component").select(F.struct("sig").alias("c_key"), "component_id", "n_links")
    full = described.where("n > 0").select("doc_id", "n", F.struct("sig").alias("d_key"))
    return (full.join(of_set, F.col("d_key") == F.col("c_key"))
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
            .unionByName(described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"),
                                                         F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))))


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    return components_and_links(docs, size, percent).drop("n_links")


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest doc_id (null is
    larger than any other; of several texts of that id the one with the smallest digest), and
    all rows without words. Rows that repeat both doc_id and text stay once."""
    described, named = _sets_with_components(docs, size, percent)
    chosen = named.groupBy("component").agg(F.min("least").alias("least")).select(
        F.col("least.doc_id").alias("l_id"), F.col("least.digest").alias("l_digest"))
    rows = described.select("doc_id", "digest", "n")
    stay = rows.where("n > 0").join(
        chosen, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("digest") == F.col("l_digest")), "left_semi")
    return keep_rows(docs, stay.unionByName(rows.where("n = 0")), _digest())
