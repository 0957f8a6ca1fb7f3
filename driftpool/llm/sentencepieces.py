"""SentencePiece BPE with seeded merge-dropout, and lossless decoding."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from driftpool.llm.bounds import Grown, Numbered, worker_store

SPACE = "▁"
NONE = 1 << 30
SEED = 42
DROPOUT = 0.1
KEPT_BYTES = 48 << 20       # of outcomes a worker keeps
CHUNK = 1 << 16             # words whose candidates are drawn together
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _mixed(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Spelling:
    """Pieces of a BPE model with byte fallback, and what they spell."""

    def __init__(self, model: str | bytes):
        sp = sentencepiece.SentencePieceProcessor(
            **({"model_proto": model} if isinstance(model, bytes) else {"model_file": model}))
        self.n = sp.get_piece_size()
        self.byte, self.normal, self.scores = {}, {}, {}
        self.raw = raw = [b""] * self.n
        for i in range(self.n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.normal[piece], self.scores[i] = i, sp.get_score(i)
                raw[i] = piece.replace(SPACE, " ").encode("utf-8")
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(raw) + b"\0", np.uint8)

    def texts(self, lists: pa.ListArray) -> pa.Array:
        """What lists of ids spell, without the space put before each text."""
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        sizes, starts = self.sizes[ids], self.starts[ids]
        first = (np.cumsum(counts) - counts)[counts > 0]
        lead = self.pool[starts[first]] == 32 if len(first) else first.astype(bool)
        sizes[first[lead]] -= 1
        starts[first[lead]] += 1
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        spelled = self.pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
        stops = np.append(0, ends)[np.append(0, np.cumsum(counts))].astype(np.int32)
        out = pa.StringArray.from_buffers(len(lists), pa.py_buffer(stops), pa.py_buffer(spelled.tobytes()))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:     # ids that spell no whole characters
            raw = spelled.tobytes()
            out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(stops, stops[1:])], pa.string())
        return pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.string()))


class Pieces(Spelling):
    """The merges of the model as well."""

    def __init__(self, model: str | bytes):
        super().__init__(model)
        if len(self.byte) != 256:
            raise ValueError("decoding is lossless only for models with byte fallback")
        # higher scores merge first
        n, normal = self.n, self.normal
        order = sorted(normal.values(), key=lambda i: (-self.scores[i], i))
        rank = {i: k for k, i in enumerate(order)}
        merges = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = normal.get(piece[:cut]), normal.get(piece[cut:])
                if a is not None and b is not None:
                    merges[a * n + b] = (rank[i], i)
        keys = np.array(sorted(merges), np.int64)
        self.keys = np.append(keys, np.int64(1 << 62))
        self.ranks = np.array([merges[k][0] for k in keys.tolist()] + [NONE], np.int32)
        self.merged = np.array([merges[k][1] for k in keys.tolist()] + [-1], np.int32)
        self.single = {p: i for p, i in normal.items() if len(p) == 1}
        self._lay_out()
        # a space inside a piece only in runs of spaces: text may be cut before each run
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece of the model spans words")
        self.lines = not any("\n" in p and len(p) > 1 for p in normal)
        self.cut = re.compile(r"\n[^ \n]*| +[^ \n]*" if self.lines else r" +[^ ]*")
        table = np.arange(-1, -1 - 0x110000, -1, dtype=np.int32)
        for c, i in self.single.items():
            table[ord(c)] = i
        # the mark for spaces is no space where the text itself has it
        table[ord(" ")], table[ord(SPACE)] = table[ord(SPACE)], -1 - ord(SPACE)
        self.symbols = table

    def _lay_out(self):
        # slots of a hash of the pair; where two pairs share one, the sorted keys are searched
        slots = self._slot(self.keys[:-1])
        self.slots = np.full(1 << 21, len(self.keys) - 1, np.int32)
        self.slots[slots] = np.arange(len(slots))
        self.shared = np.zeros(1 << 21, bool)
        values, counts = np.unique(slots, return_counts=True)
        self.shared[values[counts > 1]] = True

    def _slot(self, key):
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def _find(self, key):
        slot = self._slot(key)
        at = self.slots[slot]
        odd = np.flatnonzero(self.shared[slot])
        if len(odd):
            at[odd] = np.searchsorted(self.keys, key[odd])
        return at

    def _candidates(self, left, right, code, dropped):
        """(rank, merged piece) of neighbours; NONE where there is no merge or it is one of those dropped."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.n + right, np.int64(-1))
        at = self._find(key)
        hit = self.keys[at] == key
        if dropped is not None:
            hit &= ~(dropped == code[:, None]).any(axis=1)
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], -1)

    def parts(self, text: str) -> list[str]:
        """Pieces of a text that no merge crosses; a plain word stands for itself with a space before it."""
        if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            found = self.cut.findall(" " + text)
            return [x[1:] if x[0] == " " and x[1:2] not in ("", " ") else x for x in found]
        return (text.replace("\n", " \n") if self.lines else text).split(" ")

    def segment(self, parts: list[str], dropped: np.ndarray | None = None):
        """(ids, merges) of every part: ids as little-endian uint32, codes of its merges in the order they are made.

        Parts are merged side by side, one merge a part and round: of its candidates the one of best rank is taken
        next, leftmost of equals, unless it is in the part's row of ``dropped``. A candidate is a left and a right
        piece; its code holds where they begin, meet and end.
        """
        out = [b""] * len(parts)
        bare = " \n" if self.lines else " "
        parts = [x if x[0] in bare else " " + x for x in parts]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        text = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        sym = self.symbols[text]
        word = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
        beg = (np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        rank = np.full(len(text), NONE, np.int32)
        made = []

        def code_of(at):
            # a piece ends where the next one of its word begins
            after = np.minimum(at + 2, len(sym) - 1)
            stop = np.where((at + 2 < len(sym)) & (word[after] == word[at]), beg[after], lengths[word[at]])
            return (beg[at].astype(np.int64) << np.int64(42)) | (beg[at + 1].astype(np.int64) << np.int64(21)) | stop

        def look(at):
            at = at[(at >= 0) & (at < len(sym))]
            rank[at] = NONE
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
            rank[at] = self._candidates(sym[at], sym[at + 1], None if dropped is None else code_of(at),
                                        None if dropped is None else dropped[word[at]])[0]

        look(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat((rank.astype(np.int64) << np.int64(32)) | np.arange(len(sym)), first)
            done = best >> np.int64(32) >= NONE
            at = best[~done] & np.int64(0xFFFFFFFF)
            keep = np.ones(len(sym), bool)
            ended = int(done.sum())
            if 4 * ended > len(done) or not len(at):
                sizes = np.diff(np.append(first, len(sym)))
                mask = np.repeat(done, sizes)
                self._emit(out, sym[mask], word[first[done]], sizes[done])
                keep = ~mask
            if not len(at):
                break
            made.append((word[at], code_of(at)))
            sym[at] = self._candidates(sym[at], sym[at + 1], None, None)[1]
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at] if 4 * ended > len(done) else at - np.arange(len(at))
            sym, word, beg, rank = (x[keep] for x in (sym, word, beg, rank))
            look(np.concatenate([at, at - 1]))
        owner = np.concatenate([w for w, _ in made]) if made else np.zeros(0, np.int64)
        codes = np.concatenate([c for _, c in made]) if made else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return out, codes[order], np.bincount(owner, minlength=len(parts))

    def _emit(self, out, sym, words, sizes):
        ends = np.cumsum(sizes)
        odd = np.logical_or.reduceat(sym < 0, ends - sizes)
        flat, last = sym.astype("<u4").tobytes(), 0
        for w, end, spelled in zip(words.tolist(), ends.tolist(), odd.tolist()):
            if not spelled:
                out[w] = flat[4 * last:4 * end]
            else:
                ids = []
                for s in sym[last:end].tolist():
                    ids += [s] if s >= 0 else [self.byte[b] for b in chr(-1 - s).encode("utf-8")]
                out[w] = np.array(ids, "<u4").tobytes()
            last = end


def pieces(model: bytes, kind: type = Pieces) -> Spelling:
    store = worker_store("sentencepieces")
    key = (kind.__name__, hash(model))
    if key not in store:
        store[key] = kind(model)
    return store[key]


class Encoder:
    """Texts to ids, every word drawn for itself.

    A word's outcomes are a tree. Its root is the segmentation without dropout and the merges it makes; what the
    first of these to be dropped leads to is a child, with the merges made from there on. A word's own hashes of these
    merges, in their order, lead it down the tree: merges that are not reached are not drawn, and what the agenda does
    with the same draws is the same. Outcomes are kept up to KEPT_BYTES and made again when they are needed.
    """

    def __init__(self, table: Pieces, dropout: float, seed: int):
        self.table, self.seed = table, seed
        self.limit = np.uint64(min(int(dropout * 2 ** 64), 2 ** 64 - 1))
        self.clear()

    def clear(self):
        self.numbers, self.roots, self.words, self.bytes = Numbered(), Grown(np.int64), [], 0
        # of each outcome: its word, the outcome and slot it comes from, merges made before, and where its lists are
        self.word, self.parent, self.slot, self.passed, self.first, self.count, self.at, self.size = (
            Grown(np.int64) for _ in range(8))
        self.codes, self.child, self.ids = Grown(np.int64), Grown(np.int32), Grown(np.uint32)

    def _add(self, words, parents, slots, passed, found):
        ids, codes, counts = found
        own = counts - passed
        skip = np.cumsum(counts) - counts
        keep = np.arange(len(codes)) - np.repeat(skip, counts) >= np.repeat(passed, counts)
        begin = self.word.size
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        for column, values in ((self.word, words), (self.parent, parents), (self.slot, slots), (self.passed, passed),
                               (self.first, self.codes.size + np.cumsum(own) - own), (self.count, own),
                               (self.at, self.ids.size + np.cumsum(sizes) - sizes), (self.size, sizes)):
            column.add(values)
        self.codes.add(codes[keep])
        self.child.add(np.full(int(own.sum()), -1, np.int32))
        self.ids.add(flat)
        self.bytes += 64 * len(ids) + 12 * int(own.sum()) + 4 * len(flat)
        return np.arange(begin, begin + len(ids))

    def _rooted(self, words):
        """Outcome without dropout of each word."""
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        fresh, self.numbers.fresh = self.numbers.fresh, []
        for at in range(0, len(fresh), 1 << 15):
            part = fresh[at:at + (1 << 15)]
            none = np.zeros(len(part), np.int64)
            self.roots.add(self._add(np.arange(len(self.words), len(self.words) + len(part)), none - 1, none, none,
                                     self.table.segment(part)))
            self.words += part
            self.bytes += sum(map(len, part)) + 160 * len(part)
        return self.roots.data[number]

    def _grown(self, parents, slots):
        """Outcomes below others, where the merge of a slot is dropped."""
        for at in range(0, len(slots), 1 << 15):
            parent, slot = parents[at:at + (1 << 15)], slots[at:at + (1 << 15)]
            dropped, above = [self.codes.data[slot]], parent
            while (above >= 0).any():       # what was dropped on the way down; -1 is no code
                up = self.parent.data[above]
                dropped.append(np.where((above >= 0) & (up >= 0), self.codes.data[self.slot.data[above]], -1))
                above = np.where(above >= 0, up, -1)
            word = self.word.data[parent]
            parts = [self.words[w] for w in word.tolist()]
            passed = self.passed.data[parent] + slot - self.first.data[parent]
            made = self._add(word, parent, slot, passed, self.table.segment(parts, np.column_stack(dropped)))
            self.child.data[slot] = made

    def _drawn(self, node, salt):
        """The outcome that each word's draws lead to."""
        active = np.flatnonzero(self.count.data[node])
        while len(active):
            count = self.count.data[node[active]]
            owner = np.repeat(np.arange(len(active)), count)
            slot = np.arange(len(owner)) + np.repeat(self.first.data[node[active]] - (np.cumsum(count) - count), count)
            drawn = _mixed(_mixed(np.repeat(salt[active], count) ^ self.codes.data[slot].view(np.uint64)) + np.uint64(7))
            hit = np.flatnonzero(drawn < self.limit)
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])] if len(hit) else hit
            active, slot = active[owner[hit]], slot[hit]
            new, one = np.unique(slot[self.child.data[slot] < 0], return_index=True)
            if len(new):
                self._grown(node[active[self.child.data[slot] < 0][one]], new)
            node[active] = self.child.data[slot]
            active = active[self.count.data[node[active]] > 0]
        return node

    def encode(self, texts: list[str | None], keys: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, flat ids). A word's draws depend on the seed, the key of its text and its place among its words."""
        if self.bytes > KEPT_BYTES:
            self.clear()
        split = [self.table.parts(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for part in split for w in part]
        with np.errstate(over="ignore"):
            own = _mixed(np.array([k or 0 for k in keys], np.int64).view(np.uint64) + np.uint64(hash_of(self.seed, 0)))
            place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
            salt = _mixed(np.repeat(own, counts) + place.astype(np.uint64))
            node = self._rooted(words)
            if self.limit:
                for at in range(0, len(node), CHUNK):
                    part = slice(at, at + CHUNK)
                    node[part] = self._drawn(node[part], salt[part])
        size = self.size.data[node]
        total = np.append(0, np.cumsum(size))
        where = np.arange(total[-1]) + np.repeat(self.at.data[node] - total[:-1], size)
        return total[np.append(0, np.cumsum(counts))], self.ids.data[where].astype(np.int32)


def hash_of(seed: int, key: int) -> int:
    return xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed)


def _encoder(model, dropout, seed):
    store = worker_store("sentencepieces")
    key = ("encoder", hash(model), dropout, seed)
    if key not in store:
        store.clear()
        store[key] = Encoder(pieces(model), dropout, seed)
    return store[key]


def _model(model: str) -> bytes:
    with open(model, "rb") as f:
        return f.read()


def token_ids(key: Column, text: Column, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> Column:
    """array<int> of a text's pieces, with merges dropped by a keyed hash.

    The model file is read by the driver and handed to the tasks. Every candidate of every word is drawn by a hash of
    the seed, ``key`` (a long), the word's place in the text and the candidate's place in the word, so equal words
    differ within and between texts, and the result is the same wherever and however often it is made; rows of equal
    key and text are alike, null keys are 0. Null and empty texts give an empty array. U+2581 in a text is written in
    bytes.
    """
    data = _model(model)

    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        encoder = _encoder(data, dropout, seed)
        parts = []
        keys, texts = keys.to_pylist(), texts.to_pylist()
        at = 0
        while at < len(texts):   # a few million characters at a time
            end, size = at, 0
            while end < len(texts) and (end == at or size < 1_000_000):
                size += len(texts[end] or "")
                end += 1
            offsets, flat = encoder.encode(texts[at:end], keys[at:end])
            parts.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)))
            at = end
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
    # marked so that what is derived from the ids, decoding for one, does not make the optimizer encode again
    return arrow_udf(run, "array<int>").asNondeterministic()(key.cast("long"), text.cast("string"))


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text whose pieces these are; null for null."""
    data = _model(model)

    def run(lists: pa.Array) -> pa.Array:
        table, parts, at = pieces(data, Spelling), [], 0
        ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
        while at < len(lists):      # a quarter of a million ids at a time
            goal = (ends[at - 1] if at else 0) + (1 << 18)
            end = max(at + 1, int(np.searchsorted(ends, goal)))
            parts.append(table.texts(lists.slice(at, end - at)))
            at = end
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    return arrow_udf(run, "string")(ids)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "token_ids",
            **settings) -> DataFrame:
    """All rows and columns of ``docs`` with their ids beside them; a column of that name gives way to it as ``_name``.

    Repeated rows get equal ids; rows with a null id are drawn under one key of their own.
    """
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return docs.withColumn(name, token_ids(F.xxhash64(F.col(f"`{id_col}`")), F.col(f"`{text_col}`"), **settings))
