"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its 5-word shingles (fewer words: one shingle). A
repeated shingle is labelled with its occurrence, so labelled shingles are
distinct. A sketch takes the LENGTH labelled shingles with the smallest hashes
under one hash function, in text order, as one value; a document has SKETCHES of
them. At similarity 0.8 a pair of long texts shares a sketch with probability
0.8**6 = 0.26, some of 40 with 0.999994; six are drawn without replacement, so for
pairs from EXACT shingles on the miss rate is up to 2.6e-5 (30 and 33 shingles).

Pairs with a text of fewer shingles get exact candidates. A pair at the threshold
has ceil(threshold * n) labelled shingles of each text in common, so both hold a
common one among their n - ceil(threshold * n) + 1 rarest (ties by hash): these
prefixes are keys like the sketches.

Documents sharing a sketch or key are candidates. Their similarity is M / (n + m - M) for
sequences of n and m shingles, M being the longest common subsequence, computed
inside the band that a similarity of ``threshold`` leaves. Links are exact; their
connected components are the classes.

Documents with equal word sequences form one representative before anything else. In sketch
groups of up to SMALL representatives pairs are listed, which is at most SMALL / 2
times the group. Larger groups are cut into tiles, and each pair of tiles is one
row of work that returns a spanning forest of its links. Only pairs whose texts are connected
already are left out.

Defined cases: null and empty texts are alone in their class; texts without words
are copies of equal texts only; a text of any length is compared whole, a task holds one text's hashes and
a tile's shingles; an empty table gives no rows; equal similarities need no order, as links have none; rows with null doc_id are not compared; rows with one doc_id are one
document of the graph, all of them stay if it stays; other columns are carried along.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import broadcast_if_small, carried, emptied, join_classes, stored, trim, worker_state

SHINGLE = 5
LENGTH = 6
SKETCHES = 40
THRESHOLD = 0.8
EXACT = 30
"""Pairs whose shorter text has fewer shingles are found by exact keys."""
SMALL = 32
TILE = 256
FIRST = 4
"""Sketches whose large groups are compared first."""
ID_BYTES = 32
"""Generous size of one broadcast doc_id."""
HELD = 1 << 17
"""Hashes held at once while sketching one document."""

_rng = np.random.default_rng(20)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
SEEDS = _rng.integers(1, 2**63, (SKETCHES, 2), dtype=np.uint64) | np.uint64(1)
STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
WORD_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word (A-Z lower-cased; runs of letters, digits and what is beyond ASCII)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = WORD_BYTE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else np.arange(len(raw)) - np.concatenate(
        [np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(raw))))]
    )
    with np.errstate(over="ignore"):
        value = mix(BYTE_CODES[raw] * (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)))
        value[~inside] = 0
        return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = mix(out * STEPS[k] + words[k : k + n])
    return out


def labelled(grams: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct by their occurrence."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    if new.all():
        return grams
    at = np.arange(len(grams))
    nth = np.empty(len(grams), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.where(nth > 0, mix(grams + nth * STEPS[40]), grams)


def sketches(grams: np.ndarray) -> np.ndarray:
    """Order MinHash values of a shingle sequence."""
    own = labelled(grams)
    n = len(own)
    take = min(LENGTH, n)
    rows = max(1, HELD // n)
    out = np.empty(SKETCHES, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, SKETCHES, rows):
            seeds = SEEDS[a : a + rows]
            h = own[None, :] * seeds[:, :1] + seeds[:, 1:]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(30)
            least = np.argpartition(h, take - 1, axis=1)[:, :take] if take < n else np.broadcast_to(np.arange(n), h.shape)
            picked = own[np.sort(least, axis=1)]
            value = seeds[:, 1].copy()
            for k in range(take):
                value = mix(value * STEPS[k] + picked[:, k])
            out[a : a + rows] = value
    return out


def sketch_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key (digest of the words, or of a text without words; null for no text), n (shingles), sketch, own (labelled shingles of short texts)."""
    # a partner of a text under EXACT may be so long; texts whose only partners are equal ones need no keys
    longest, shortest = EXACT / threshold, threshold / (1 - threshold) - 1e-9 if threshold < 1 else np.inf

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state("near")  # tables of the operator before go
        for batch in batches:
            keys, sizes, values, owns = [], [], [], []
            for text in batch["text"]:
                words = word_hashes(text)
                grams = shingles(words)
                # without words the text itself is compared
                digest = hashlib.blake2b(words.tobytes() if len(words) else b"text" + text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                keys.append(digest if text else None)
                sizes.append(len(grams))
                values.append(sketches(grams).view(np.int64) if len(words) else None)
                owns.append(labelled(grams).view(np.int64) if shortest <= len(grams) <= longest else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": keys, "n": sizes, "sketch": values, "own": owns})
            trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInPandas(work, "doc_id long, key string, n long, sketch array<long>, own array<long>")


def subsequence(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two sequences over cells with |i - j| <= band."""
    values, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    order = np.argsort(y, kind="stable")
    starts = np.searchsorted(y[order], np.arange(len(values)))
    counts = np.bincount(y, minlength=len(values))
    each = counts[x]
    total = int(each.sum())
    if total > 8 * (len(a) + len(b)):
        return _rows(x, y, band)
    i = np.repeat(np.arange(len(x)), each)
    j = order[np.repeat(starts[x], each) + np.arange(total) - np.repeat(np.cumsum(each) - each, each)]
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if (np.diff(j) > 0).all() and (np.diff(i) > 0).all():
        return len(j)
    # longest chain: within one i larger j come first, so an i is used once
    tails: list[int] = []
    for at in j[np.lexsort((-j, i))].tolist():
        k = bisect_left(tails, at)
        if k == len(tails):
            tails.append(at)
        else:
            tails[k] = at
    return len(tails)


def _rows(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """The same by rows of the band, for texts that repeat themselves."""
    best = np.zeros(2 * band + 2, np.int64)  # cell (i, i - band + k)
    m = len(y)
    for i in range(len(x)):
        j = np.arange(i - band, i + band + 1)
        inside = (j >= 0) & (j < m)
        same = inside & (y[np.clip(j, 0, max(m - 1, 0))] == x[i])
        # row i - 1 holds the same j one place to the right
        new = np.maximum(best[1:], best[:-1] + same)
        new = np.maximum.accumulate(new)
        best = np.append(new, new[-1])
    return int(best.max())


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """M / (n + m - M), or 0 where that is below the threshold."""
    n, m = len(a), len(b)
    least = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    if not n or not m or least > min(n, m):
        return 0.0
    common = len(np.intersect1d(labelled(a), labelled(b), assume_unique=True))
    if common < least:
        return 0.0
    matched = subsequence(a, b, max(n, m) - least)
    return matched / (n + m - matched) if matched >= least else 0.0


def shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, grams (shingle hashes as bytes) of the wanted (rep, key); equal rows of documents give equal rows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state("near")  # tables of the operator before go
        for batch in batches:
            reps, out = [], []
            for rep, key, text in zip(batch["rep"], batch["key"], batch["text"], strict=True):
                words = word_hashes(text)
                if hashlib.blake2b(words.tobytes(), digest_size=16).hexdigest() == key:
                    reps.append(rep)
                    out.append(shingles(words).tobytes())
            yield pd.DataFrame({"rep": reps, "grams": out})
            trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "rep")
    return rows.select("rep", "key", "text").mapInPandas(work, "rep long, grams binary")


def verified_pairs(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) whose alignment reaches the threshold."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state("near")  # tables of the operator before go
        for batch in batches:
            ok = [
                similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) >= threshold
                for x, y in zip(batch["x"], batch["y"], strict=True)
            ]
            yield batch.loc[ok, ["a", "b"]]
            trim()

    met = pairs.join(grams.select(F.col("rep").alias("a"), F.col("grams").alias("x")), "a")
    met = met.join(grams.select(F.col("rep").alias("b"), F.col("grams").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInPandas(work, "a long, b long")


def tile_links(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of the links of every pair of tiles (reps2 null: within a tile).

    Counts of common shingles of all pairs come from one matrix product; pairs
    they do not rule out are aligned unless already connected (equal ``known``; without that column none are).
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state("near")  # tables of the operator before go
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = row.reps2 is None
                reps = list(row.reps) + ([] if own else list(row.reps2))
                grams = [np.frombuffer(g, np.uint64) for g in list(row.grams) + ([] if own else list(row.grams2))]
                cut = 0 if own else len(row.reps)
                marks = [labelled(g) for g in grams]
                code = np.unique(np.concatenate(marks), return_inverse=True)[1]
                sizes = np.array([len(g) for g in grams])
                home = np.repeat(np.arange(len(grams)), sizes)
                # a shingle of one text adds to no pair
                times = np.bincount(code)
                shared = times[code] > 1
                code, home = (np.cumsum(times > 1) - 1)[code[shared]], home[shared]
                common = np.zeros((len(grams), len(grams)), np.float32)
                step = min(1 << 12, int(code.max(initial=0)) + 1)
                order = np.argsort(code, kind="stable")
                code, home = code[order], home[order]
                for a in range(0, int(code[-1]) + 1 if len(code) else 0, step):  # columns in blocks, so the matrix stays small
                    lo, hi = np.searchsorted(code, [a, a + step])
                    seen = np.zeros((len(grams), step), np.float32)
                    seen[home[lo:hi], code[lo:hi] - a] = 1
                    common += seen @ seen.T
                both = sizes[:, None] + sizes[None, :]
                i, j = np.nonzero(np.triu(common.astype(np.float64) * (1 + threshold) >= threshold * both - 1e-6, 1))
                if not own:
                    over = (i < cut) & (j >= cut)
                    i, j = i[over], j[over]
                # most alike first: they connect most, so fewer pairs need an alignment
                root = np.unique(list(row.known) + ([] if own else list(row.known2)), return_inverse=True)[1]
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
                rank = np.argsort(-common[i, j] / both[i, j], kind="stable")
                links = []
                for p, q in zip(i[rank].tolist(), j[rank].tolist(), strict=True):
                    if root[p] != root[q] and similarity(grams[p], grams[q], threshold) >= threshold:
                        links.append((reps[p], reps[q]))
                        root[root == root[q]] = root[p]
                if links:
                    yield pd.DataFrame(links, columns=["a", "b"])
            trim()

    if "known" not in tiles.columns:
        tiles = tiles.withColumns({"known": F.col("reps"), "known2": F.col("reps2")})
    return tiles.mapInPandas(work, "a long, b long")


def short_keys(reps: DataFrame, threshold: float) -> DataFrame:
    """rep, n, s: of short texts the shingles of the prefix that another short text holds too."""
    own = reps.where("own IS NOT NULL").select("rep", "n", F.explode("own").alias("s"))
    often = own.groupBy("s").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    met = own.join(often, "s").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("held", "s"))).alias("ranked"))
    # shingles of one text alone come first and fill places of the prefix
    places = F.size("ranked") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    kept = met.withColumn("places", places).where("places > 0")
    return kept.select("rep", "n", F.explode(F.slice("ranked", F.lit(1), F.col("places"))).alias("e")).select("rep", "n", F.col("e")["s"].alias("s"))


def tile_pairs(members: DataFrame, grams: DataFrame, tile: int) -> DataFrame:
    """Pairs of tiles (known, reps, grams and known2, reps2, grams2) of the members (s, rep, known) of sketch groups.

    A component that fills a tile has tiles of its own; a pair of tiles with one component in both is left out.
    """
    sizes = members.groupBy("s", "known").agg(F.count(F.lit(1)).alias("c"))
    rest = sizes.where(F.col("c") <= tile).groupBy("s").agg(F.ceil(F.sum("c") / tile).cast("int").alias("pooled"))
    big = sizes.where(F.col("c") > tile)
    placed = members.join(rest, "s", "left").join(big, ["s", "known"], "left")
    own = F.xxhash64("known", F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / tile)))
    placed = placed.withColumn("tile", F.when(F.col("c").isNull(), F.pmod(F.xxhash64("known"), F.col("pooled"))).otherwise(own))
    packed = stored(
        placed.join(grams, "rep").groupBy("s", "tile").agg(F.collect_list(F.struct("known", "rep", "grams")).alias("m"))
        .select("s", "tile", F.col("m")["known"].alias("known"), F.col("m")["rep"].alias("reps"), F.col("m")["grams"].alias("grams")),
        "tiles",
    )
    label = F.when(F.array_min("known") == F.array_max("known"), F.array_min("known"))
    slim = packed.select("s", "tile", label.alias("label"))
    others = slim.select("s", F.col("tile").alias("other"), F.col("label").alias("label2"))
    met = slim.join(others, "s").where("tile <= other").where(F.coalesce(F.col("label") != F.col("label2"), F.lit(True)))
    right = packed.select("s", F.col("tile").alias("other"), *[F.col(c).alias(f"{c}2") for c in ("known", "reps", "grams")])
    columns = ["known", "reps", "grams", "known2", "reps2", "grams2"]
    same = packed.join(met.where("tile = other").select("s", "tile"), ["s", "tile"])
    same = same.select("known", "reps", "grams", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns[3:]])
    across = packed.join(met.where("tile < other").select("s", "tile", "other"), ["s", "tile"]).join(right, ["s", "other"])
    return same.unionByName(across.select(*columns))


def near_links(docs: DataFrame, reps: DataFrame, threshold: float, small: int, tile: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b) links between representatives (rep, key, n, sketch, own), whole up to connectivity; and the stored tables they are read from.

    Links are stored: one task then runs one Python worker at a time, while what reads the links may run its own.
    Large groups are compared in two rounds: those of the first FIRST sketches, then those of the others whose
    members are not all connected by then. So texts that share dozens of sketches are compared a few times, not dozens.
    """
    keys = stored(short_keys(reps, threshold), "short-keys")
    entries = reps.select("rep", "n", F.posexplode("sketch").alias("number", "s")).unionByName(keys.withColumn("number", F.lit(SKETCHES)))
    groups = entries.groupBy("s").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(entries.join(groups, "s"), "sketches")
    few, many = shared.where(F.col("size") <= small), shared.where(F.col("size") > small)
    # lengths alone rule out pairs: M <= min(n, m)
    pairs = (
        few.select("s", F.col("rep").alias("a"), F.col("n").alias("n1"))
        .join(few.select("s", F.col("rep").alias("b"), F.col("n").alias("n2")), "s")
        .where("a < b")
        .where((F.least("n1", "n2") >= F.greatest("n1", "n2") * threshold))
        .select("a", "b")
        .distinct()
    )
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(many.select("rep")).distinct()
    grams = stored(shingles_of(docs, wanted.join(reps.select("rep", "key"), "rep")), "shingles")
    links = verified_pairs(pairs, grams, threshold)
    if not many.head(1):
        return stored(links, "links"), [shared, grams]
    first = many.where(F.col("number") < FIRST).select("s", "rep", F.col("rep").alias("known"))
    links = stored(links.unionByName(tile_links(tile_pairs(first, grams, tile), threshold)), "links")
    later = many.where(F.col("number") >= FIRST).select("s", "rep").distinct()
    later = later.join(components(links), F.col("rep") == F.col("node"), "left").select("s", "rep", F.coalesce("component", "rep").alias("known"))
    later = stored(later, "later")
    open_ = later.groupBy("s").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo < hi").select("s")
    return stored(links.unionByName(tile_links(tile_pairs(later.join(open_, "s"), grams, tile), threshold)), "links"), [shared, grams]


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, small: int = SMALL, tile: int = TILE) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), kept (it is this document): one row for every doc_id that is not null."""
    marked = stored(sketch_documents(docs, threshold), "marked")
    reps = stored(
        marked.where("key IS NOT NULL").groupBy("key").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("own").alias("own"), F.count(F.lit(1)).alias("copies")
        ),
        "reps",
    )
    many = reps.where("copies > 1").select("key", "rep", F.col("copies").alias("n"))
    members = join_classes(marked.select("doc_id", "key"), many, "key", "doc_id").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    members = stored(members, "members")
    emptied(marked)
    links, read = near_links(docs, reps, threshold, small, tile)
    if members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):
        # one doc_id stands for several rows: its texts are one node, and it gets one row
        links = links.unionByName(members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
        members = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    found = components(links)
    # from here on only members and components are read
    emptied(reps, *read)
    out = members.join(found, members["rep"] == found["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    return out.withColumn("kept", F.col("class_id") == F.col("doc_id"))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class; rows with null doc_id stay."""
    gone = stored(near_classes(docs, threshold).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")), "gone")
    # few ids: texts stay where they are, else they meet them by a shuffle
    gone = broadcast_if_small(gone, gone.count(), ID_BYTES)
    inner, finish = carried(docs, "doc_id", "text")
    return finish(inner.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti"))
