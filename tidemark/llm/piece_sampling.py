"""SentencePiece segmentation by forward filtering and backward sampling; lossless decoding.

A text gets a space in front and spaces become the meta sign, as the vocabulary
expects. Its segmentations are the paths of a lattice: an edge for every piece of the
vocabulary, and byte pieces for characters that have none. A path's probability is the
product of its pieces' weights, (1 + rank) ** -alpha for merge rank (Zipf's law; byte
pieces rank last). Sums over path prefixes are filtered forward in logarithms; then
pieces are drawn backward from the end. No piece spans the border before a space that
follows another character, so sums are computed once per distinct word of a batch, and
every occurrence draws for itself. Draws are hashes of (row seed, word in the text,
step): equal rows, seeds and alpha give equal pieces, whatever the batch or task.

A meta sign in a text itself is encoded as its bytes, so decoding gives back every text.

Defined cases: null text gives null pieces, and null text again; empty text no
pieces; a null row key is a key like others; ids that are no piece decode to nothing;
other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import carried, trim, worker_state

META = 0x2581
ALPHA = 1.0
GROUP = 1_000_000
BLOCK = 100_000
"""Characters of distinct words whose lattices are held at once."""


class Pieces:
    """Vocabulary tables: bytes of every piece and, for encoding, a trie over characters and weights."""

    def __init__(self, path: str, encodes: bool = True):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if sp.is_byte(i)]
        real = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if len(byte) != 256 or any(chr(META) in names[i].lstrip(chr(META)) for i in real):
            raise ValueError("the vocabulary must have byte pieces, and meta signs only at the start of pieces")
        self.byte_ids = np.array(byte, np.int64)
        self.raw = [b""] * n
        for i in real:
            self.raw[i] = names[i].replace(chr(META), " ").encode()
        for b, i in enumerate(byte):
            self.raw[i] = bytes([b])
        if encodes:
            self._build(names, real)

    def _build(self, names: list[str], real: list[int]) -> None:
        n = len(names)
        self.log_rank = np.zeros(n)
        self.log_rank[real] = np.log(1.0 + np.arange(len(real)))
        self.byte_rank = float(np.log(1.0 + len(real)))
        self.longest = max(len(names[i]) for i in real)
        self.single = np.full(0x110000, -1, np.int32)
        longer = [i for i in real if len(names[i]) > 1]
        signs = sorted({c for i in longer for c in names[i]})
        self.sign = np.zeros(0x110000, np.int16)
        self.sign[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        inner = {"": 0}
        for i in longer:
            for k in range(1, len(names[i])):
                inner.setdefault(names[i][:k], len(inner))
        # going on from an inner node: the next inner node, and the piece that ends here
        kind = np.int16 if max(n, len(inner)) < 1 << 15 else np.int32
        self.next = np.full((len(inner), len(signs) + 1), -1, kind)
        self.ends = np.full((len(inner), len(signs) + 1), -1, kind)
        for name, node in inner.items():
            if name:
                self.next[inner[name[:-1]], self.sign[ord(name[-1])]] = node
        for i in real:
            if len(names[i]) == 1:
                self.single[ord(names[i])] = i
            else:
                self.ends[inner[names[i][:-1]], self.sign[ord(names[i][-1])]] = i


def pieces_of(path: str, encodes: bool = True) -> Pieces:
    kept = worker_state("pieces")
    key = ("pieces", path, encodes)
    if key not in kept:
        kept[key] = Pieces(path, encodes)
    return kept[key]


def utf8(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of characters, padded to four, and how many they are."""
    c = codes.astype(np.int64)
    n = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    out = np.zeros((len(c), 4), np.int64)
    for size, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        own = n == size
        for k in range(size):
            bits = c[own] >> (6 * (size - 1 - k))
            out[own, k] = bits | lead if k == 0 else (bits & 0x3F) | 0x80
    return out, n


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the word number of every occurrence, and where each text's occurrences end.

    A word is one or more spaces and what follows up to the next space; the
    spaces are kept as ' ' at its start. Empty texts have none.
    """
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    offsets = split.offsets.to_numpy()
    coded = split.values.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    words = coded.dictionary.to_pylist()
    keep = np.ones(len(codes), bool)
    if "" in words:
        # spaces in a row give empty parts; they join the word after them
        number = {w: i for i, w in enumerate(words)}
        blank = number[""]
        last = np.zeros(len(codes), bool)
        last[offsets[1:][np.diff(offsets) > 0] - 1] = True
        texts_empty = np.array([not t for t in texts], bool)
        keep[offsets[:-1][texts_empty]] = False
        run = 0
        for at in np.flatnonzero((codes == blank) & keep).tolist():
            if run and at != before + 1:
                run = 0
            before = at
            if last[at]:
                name = " " * run
                run = 0
            elif codes[at + 1] == blank:
                keep[at], run = False, run + 1
                continue
            else:
                keep[at] = False
                at += 1
                name, run = " " * (run + 1) + words[codes[at]], 0
            codes[at] = number.setdefault(name, len(number))
            if len(number) > len(words):
                words.append(name)
    seen = np.cumsum(keep)
    ends = np.append(0, seen)[offsets[1:]]
    return words, codes[keep], ends


class Lattice:
    """Forward sums of a block of words: for every place, the edges that end there and their shares."""

    def __init__(self, p: Pieces, words: list[str], alpha: float):
        text = "".join([" " + w for w in words])
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(w) + 1 for w in words])
        self.first = np.cumsum(sizes) - sizes  # first character; places are characters plus one per word
        word = np.repeat(np.arange(len(words)), sizes)
        literal = codes == META
        codes[codes == 0x20] = META
        sign = p.sign[codes].astype(np.int64)
        sign[literal] = 0
        single = p.single[codes].astype(np.int64)
        single[literal] = -1
        n = len(codes)
        at = np.arange(n)
        stop = (self.first + sizes)[word]
        # edges by length: (first character, piece); -1 for byte pieces
        found = [(at, single)]
        node, active = np.zeros(n, np.int64), at
        for d in range(1, p.longest + 1):
            s = sign[active + d - 1]
            piece, node = p.ends[node, s], p.next[node, s]
            hit = piece >= 0
            if d > 1:
                found.append((active[hit], piece[hit].astype(np.int64)))
            on = (node >= 0) & (active + d < stop[active])
            active, node = active[on], node[on].astype(np.int64)
            if not len(active):
                break
        # place of character i is i + word; the end of an edge of length d is d further
        places = n + len(words)
        count = np.zeros(places + 1, np.int64)
        for d, (start, _) in enumerate(found, 1):
            count[start + word[start] + d] += 1
        self.base = np.cumsum(count) - count
        self.count = count
        total = int(count.sum())
        self.length, self.piece, weight = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
        fill = self.base.copy()
        width = utf8(codes)[1]
        for d in range(len(found), 0, -1):  # longer edges first: they are drawn most
            start, piece = found[d - 1]
            end = start + word[start] + d
            slot = fill[end]
            fill[end] += 1
            self.length[slot], self.piece[slot] = d, piece
            weight[slot] = -alpha * np.where(piece >= 0, p.log_rank[piece], p.byte_rank * width[start])
        self.codes, self.sizes, self.word = codes, sizes, np.append(word, 0)
        self.begin = self.first + np.arange(len(words))
        sums = np.zeros(places + 1)
        self.share = np.empty(total)
        order = np.argsort(-sizes, kind="stable")
        for t in range(1, int(sizes.max(initial=0)) + 1):
            own = self.begin[order[: np.searchsorted(-sizes[order], -t, side="right")]] + t
            c = count[own]
            heads = np.cumsum(c) - c
            edge = np.repeat(self.base[own] - heads, c) + np.arange(int(c.sum()))
            value = sums[np.repeat(own, c) - self.length[edge]] + weight[edge]
            top = np.maximum.reduceat(value, heads)
            grown = np.exp(value - np.repeat(top, c))
            whole = np.add.reduceat(grown, heads)
            sums[own] = top + np.log(whole)
            self.share[edge] = grown / np.repeat(whole, c)

    def draw(self, p: Pieces, words: np.ndarray, seeds: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of occurrences (block word, row seed, number in the text) in a row, and how many each has."""
        place = self.begin[words] + self.sizes[words]
        left = np.arange(len(words))
        used = np.zeros(len(words), np.int64)
        drawn = []
        with np.errstate(over="ignore"):
            key = seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        step = 0
        while len(left):
            with np.errstate(over="ignore"):
                h = key[left] + np.uint64(step * 0x94D049BB133111EB % 2**64)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.base[place]
            final = edge + self.count[place] - 1
            u -= self.share[edge]
            more = np.flatnonzero((u >= 0) & (edge < final))
            while len(more):
                edge[more] += 1
                u[more] -= self.share[edge[more]]
                more = more[(u[more] >= 0) & (edge[more] < final[more])]
            piece = self.piece[edge]
            size = np.ones(len(left), np.int64)
            raw = np.flatnonzero(piece < 0)
            if len(raw):
                who = place[raw] - 1 - words[left[raw]]
                values, size[raw] = utf8(self.codes[who])
                for k in range(4):
                    own = size[raw] > k
                    # counted from the end of the occurrence
                    drawn.append((left[raw][own], used[left[raw][own]] + size[raw][own] - k, p.byte_ids[values[own, k]]))
            plain = piece >= 0
            drawn.append((left[plain], used[left[plain]] + 1, piece[plain]))
            used[left] += size
            place = place - self.length[edge]
            on = place > self.begin[words[left]]
            left, place = left[on], place[on]
            step += 1
        ends = np.cumsum(used)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for who, back, ids in drawn:
            out[ends[who] - back] = ids
        return out, used


def sample(p: Pieces, texts: list[str], seeds: np.ndarray, alpha: float = ALPHA) -> list[np.ndarray]:
    """Sampled ids of every text."""
    flat, cuts = sample_flat(p, texts, seeds, alpha)
    return np.split(flat, cuts[:-1]) if len(texts) else []


def sample_flat(p: Pieces, texts: list[str], seeds: np.ndarray, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts in a row, and where each text's ids end."""
    words, codes, ends = words_of(texts)
    starts = np.append(0, ends[:-1]).astype(np.int64) if len(ends) else ends
    sizes = ends - starts
    nth = np.arange(len(codes)) - np.repeat(starts, sizes)
    seed = np.repeat(seeds, sizes)
    lengths = np.cumsum([len(w) + 1 for w in words])
    parts = np.searchsorted(lengths, np.arange(0, lengths[-1] if len(words) else 0, BLOCK), side="left")
    parts = np.unique(np.append(parts, len(words)))
    counts = np.zeros(len(codes), np.int64)
    blocks = []
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    for a, b in zip(np.append(0, parts[:-1]).tolist() if len(parts) else [], parts.tolist(), strict=True):
        if a == b:
            continue
        own = order[np.searchsorted(ranked, a) : np.searchsorted(ranked, b)]
        own.sort()
        ids, used = Lattice(p, words[a:b], alpha).draw(p, codes[own] - a, seed[own], nth[own])
        counts[own] = used
        blocks.append((own, ids, used))
    place = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), np.int32)
    for own, ids, used in blocks:
        flat[np.repeat(place[own] - (np.cumsum(used) - used), used) + np.arange(len(ids))] = ids
    return flat, np.append(place, len(flat))[ends]


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with at most ``most`` in all, or one row."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def encode(docs: DataFrame, model: str, seed: int = 0, alpha: float = ALPHA, key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``piece_ids``, sampled with the row's ``key`` and ``seed``; with ``decoded`` also the text these give back, in one pass.

    Arrow batches are cut by the length of their texts, so a task holds the strings
    and lattices of a few texts at a time, whatever the batch holds.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy(zero_copy_only=False) + 1
            for a, b in slices(sizes, GROUP):
                part = batch.slice(a, b - a)
                missing = part["text"].is_null().to_numpy(zero_copy_only=False)
                flat, ends = sample_flat(p, pc.fill_null(part["text"], "").to_pylist(), part["_seed"].to_numpy(), alpha)
                offsets = pa.array(np.append(0, ends), pa.int32(), mask=np.append(missing, False))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                names = [n for n in part.schema.names if n != "_seed"]
                columns, new = [*[part[n] for n in names], ids], ["piece_ids"]
                if decoded:
                    columns.append(pa.array(texts_of(p, flat, np.append(0, ends), ~missing), pa.string()))
                    new.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])
            trim()

    inner, finish = carried(docs, *dict.fromkeys(("text", key)))
    row_seed = F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))
    new = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())][: 2 if decoded else 1]
    out = inner.withColumn("_seed", row_seed).mapInArrow(draw, T.StructType([*inner.schema.fields, *new]))
    return finish(out, *[f.name for f in new])


def texts_of(p: Pieces, ids: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> list[str | None]:
    return [decode_ids(p, ids[a:b]) if k else None for a, b, k in zip(offsets[:-1], offsets[1:], known, strict=True)]


def decode_ids(p: Pieces, ids) -> str:
    n = len(p.raw)
    text = b"".join([p.raw[i] for i in np.asarray(ids).tolist() if 0 <= i < n]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def decode(docs: DataFrame, model: str) -> DataFrame:
    """All columns of ``docs`` plus ``decoded``, the text of ``piece_ids``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model, encodes=False)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch["piece_ids"]), 0).to_numpy(zero_copy_only=False) + 1
            for a, b in slices(sizes, GROUP // 2):
                part = batch.slice(a, b - a)
                ids = part["piece_ids"]
                values, offsets = pc.fill_null(ids.values, -1).to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                texts = texts_of(p, values, offsets, known)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])
            trim()

    inner, finish = carried(docs, "piece_ids")
    out = inner.mapInArrow(join, T.StructType([*inner.schema.fields, T.StructField("decoded", T.StringType())]))
    return finish(out, "decoded")
