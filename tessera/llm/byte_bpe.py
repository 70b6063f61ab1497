"""Byte-level BPE encoding and decoding.

Spark higher-order functions fold ranked merges over the bytes of distinct
words (pre-tokens), with the ranks as one literal map:

1. the words that several partitions hold are counted and folded once for the
   whole table; at most ``SHARED`` of them, the most widespread, are sent to
   all tasks as arrays of fixed size (hash, ids);
2. a Python pass streams each partition's rows, turns every text into the codes
   of its words, and sends, ahead of the documents, each word that it has not
   met yet: with its ids if it is a token itself or shared, else as bytes;
3. these are folded in the same stage;
4. a second Python pass, fed in the same order, keeps the ids of each code and
   puts each document's ids together.

No text is shuffled, only the words of step 1.  A fold's step reads the whole
word, so a word costs the square of its bytes.  Words of more than ``LONG``
bytes (unbroken runs, not words of a language) are merged in step 2 with a heap
instead, to the same ids.

A partition's word list is started anew when it holds ``max_words`` words (in
the folding stage at most ``MAX_CODED``) or
``MAX_HELD`` characters, on both sides at the same row, so memory is bounded
whatever the corpus.  The stage keeps no state outside its partition: a lost
executor repeats a split.

Decoding concatenates the ids' binary pieces.

Defined results: a null or empty text has no ids; null ids (of a document or
of words) never occur in the output; repeated rows are encoded each; texts may
be as long as a row can be; columns other than the id and the text are left
out, so none can clash; an empty table gives an empty result.  Text is split by
the tables for letters and numbers of the ``regex`` module.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word list of this many entries is dropped and begun again.
MAX_WORDS = 500_000
#: So is one of this many entries in the stage that folds, where two workers of each task hold it.
MAX_CODED = 200_000
#: So is one of this many characters.
MAX_HELD = 32_000_000
#: Words that are folded once and sent to all tasks, at most.
SHARED = 1 << 20
#: Bytes of the longest word that is folded.
LONG = 1024
#: Bytes of text that a worker splits at once.
SLICE = 2 << 20
#: Marks that end a piece of text and are words of their own there.
MARKS = ".,;:!?"
#: Letters of which a word may consist that is told without the pattern: ranges of Latin script.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Bits of an id in the literal rank map: a pair of ids and the id it makes share one 64-bit integer.
ID_BITS = 20
#: Stands for "no such pair" among ranks.
NO_RANK = (1 << 20) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """From each pair of ids (left id in the high bits) whose bytes make a token to that token's rank."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << ID_BITS | right] = rank
    return pairs


def _slots(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """A hash table without collisions: (shift of each bucket, packed pair and rank of each slot).

    A key belongs to bucket ``key % len(shifts)`` and lies in slot
    ``(key % 2147483629 + shift) % len(slots)`` (see ``_rank``).
    """
    n_buckets, n_slots = max(1, len(pairs) // 2) | 1, len(pairs) * 3 // 2 | 1
    buckets: dict[int, list[int]] = {}
    for key in pairs:
        buckets.setdefault(key % n_buckets, []).append(key)
    shifts, slots, free = [0] * n_buckets, [-1] * n_slots, 0
    for bucket in sorted(buckets, key=lambda b: -len(buckets[b])):
        bases = [key % 2147483629 % n_slots for key in buckets[bucket]]
        if len(set(bases)) < len(bases):
            raise ValueError("two pairs of a bucket meet in one slot whatever the shift")
        shift = 0 if len(bases) > 1 else free - bases[0]
        while any(slots[(base + shift) % n_slots] >= 0 for base in bases):
            shift += 1
        for key, base in zip(buckets[bucket], bases, strict=True):
            slots[(base + shift) % n_slots] = key << ID_BITS | pairs[key]
        shifts[bucket] = shift % n_slots
        while len(bases) == 1 and free < n_slots and slots[free] >= 0:
            free += 1
    return shifts, slots


def fold_expression(ranks: dict[bytes, int], word: str) -> str:
    """SQL for the ids that the byte ids in the array ``word`` merge to.

    The state is one array of 64-bit integers, a piece each: the rank of the
    piece joined with its right neighbour, the piece's first byte, its id.  Its
    least entry is the leftmost pair of the least rank; a step gives that
    piece its new id, drops its neighbour, looks up the two pairs that this
    makes and keeps what lies before and after.  As many steps as the word has
    bytes are enough; further steps change nothing.
    """
    shifts, slots = _slots(pair_ranks(ranks))
    slots = [None if x < 0 else x for x in slots]
    low = (1 << ID_BITS) - 1

    def rank(left: str, right: str) -> str:
        """The rank of two neighbouring ids, NO_RANK without such a token or a right neighbour (least() passes over nulls)."""
        key = f"(({left}) * {1 << ID_BITS}L + ({right}))"
        slot = f"get(slots, cast((({key} % 2147483629) + get(shifts, cast({key} % {len(shifts)} as int))) % {len(slots)} as int))"
        return f"least({slot} ^ shiftleft({key}, {ID_BITS}), {NO_RANK}L)"  # equal keys leave the rank, others more

    def piece(rank_sql: str, at_and_id: str) -> str:
        return f"shiftleft({rank_sql}, {2 * ID_BITS}) + ({at_and_id})"

    def id_of(x: str) -> str:
        return f"{x} & {low}"

    merged, left = f"shiftright(m, {2 * ID_BITS})", "get(s, p - 2)"
    start = f"transform({word}, (b, i) -> {piece(rank('b', f'get({word}, i + 1)'), f'i * {1 << ID_BITS}L + b')})"
    joined = piece(rank(merged, id_of("get(s, p + 1)")), f"(m & {low << ID_BITS}L) + {merged}")
    neighbour = piece(rank(id_of(left), merged), f"{left} & {(1 << 2 * ID_BITS) - 1}L")
    changed = (
        f"CASE WHEN p = 1 THEN concat(array({joined}), slice(s, 3, {1 << 30}))"
        f" ELSE concat(slice(s, 1, p - 2), array({neighbour}, {joined}), slice(s, p + 2, {1 << 30})) END"
    )
    step = _let("m", "array_min(s)", f"CASE WHEN m >= {NO_RANK << (2 * ID_BITS)}L THEN s ELSE {_let('p', 'cast(array_position(s, m) as int)', changed)} END")
    fold = f"aggregate(slice({word}, 2, {1 << 30}), {start}, (s, _) -> {step}, s -> transform(s, x -> cast({id_of('x')} as int)))"
    literals = [f"from_json('{json.dumps(x, separators=(',', ':'))}', 'array<{kind}>')" for x, kind in ((shifts, "int"), (slots, "bigint"))]
    return _let("shifts", literals[0], _let("slots", literals[1], fold))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> bytes:
    """Little-endian ids of a word in n log n steps: a heap of neighbouring pieces that make a token, least rank first, then leftmost."""
    n = len(word)
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (rank := ranks.get(pieces[i] + pieces[after[i]])) is not None:
            heapq.heappush(heap, (rank, i))

    for i in range(n):
        offer(i)
    while heap:
        rank, i = heapq.heappop(heap)
        if pieces[i] is None or after[i] == n or ranks.get(pieces[i] + pieces[after[i]]) != rank:
            continue  # one of the two has been merged since
        gone = after[i]
        pieces[i] += pieces[gone]
        pieces[gone], after[i] = None, after[gone]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return b"".join(ranks[p].to_bytes(4, "little") for p in pieces if p is not None)


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of a string or binary column, one row at least."""
    import numpy as np

    at, ends = 0, np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), "i8"))
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _spans(starts, lengths):
    """The positions start, start + 1, ... of each span, one span after the other."""
    import numpy as np

    lengths = np.asarray(lengths, "i8")
    return np.repeat(np.asarray(starts, "i8") - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _binaries(flat, counts) -> pa.Array:
    """Binary values of so many 32-bit integers each."""
    import numpy as np

    ends = np.concatenate([[0], np.cumsum(np.asarray(counts, "i8") * 4)]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])


def _listed(values: pa.Array) -> list:
    """``to_pylist`` without a scalar object for each value."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _hashes(words: pa.Array):
    """64-bit hashes of binary values."""
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, _listed(words)), "u8", len(words))


class Splitter:
    """Words of many texts at once: a text is cut at its spaces, and of the distinct pieces only those are split by the pattern that aren't letters, or letters and one mark."""

    def __init__(self, pattern: str):
        import regex

        self._find, self._blank = regex.compile(pattern).findall, regex.compile(r"\s").match
        letters = " " + "".join(regex.findall(f"[{LETTERS}]", "".join(map(chr, range(0x250)))))
        # whether the pattern keeps a space with the letters after it, and apart from the mark that follows
        self._usual = self._find(letters) == [letters] and all(self._find(letters + c) == [letters, c] and self._find(f" a{c}") == [" a", c] for c in MARKS)

    def _plain(self, pieces: pa.Array, ending: str):
        """Which pieces are letters and then ``ending``."""
        import numpy as np

        return np.asarray(pa.compute.match_substring_regex(pieces, f"^[{LETTERS}]+{ending}\\z")) & self._usual

    def __call__(self, texts: pa.Array) -> tuple:
        """The distinct words, all texts' words in order as positions among them, and how many each text has.

        A space before a character that isn't white space always begins a
        word, so a text can be cut there.  A text with other spaces is one unit.
        """
        import numpy as np
        import pyarrow.compute as pc

        texts = texts.cast(pa.string())
        split = pc.split_pattern(texts, " ")
        counts = np.asarray(split.value_lengths(), "i8")
        starts = np.cumsum(counts) - counts
        coded = split.flatten().dictionary_encode()
        pieces, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        first = np.zeros(len(codes), bool)
        first[starts] = True
        plain, marked = self._plain(pieces, ""), self._plain(pieces, f"[{MARKS}]")
        other = ~plain & ~marked
        unsafe = np.zeros(len(pieces), bool)
        unsafe[other] = [not v or (not v[0].isalnum() and self._blank(v) is not None) for v in _listed(pieces.filter(pa.array(other)))]
        whole = np.logical_or.reduceat(unsafe[codes] & ~first, starts)
        rest = ~first & ~np.repeat(whole, counts)
        used = np.zeros(len(pieces), bool)
        used[codes[rest]] = True
        plain, marked, other = np.flatnonzero(plain & used), np.flatnonzero(marked & used), np.flatnonzero(other & used)
        heads = _listed(pieces.take(pa.array(codes[starts])))
        units = [self._find(" " + v) for v in _listed(pieces.take(pa.array(other)))]
        units += [self._find(texts[row].as_py() if cut else head) for row, (cut, head) in enumerate(zip(whole.tolist(), heads, strict=True))]
        # the words of plain pieces, of marked ones, their marks, and those of the other units, one after the other
        with_mark = pieces.take(pa.array(marked))
        words = [pieces.take(pa.array(plain)), pc.utf8_slice_codeunits(with_mark, 0, -1)]
        words = [*(pc.binary_join_element_wise("", x, " ") for x in words), pc.utf8_slice_codeunits(with_mark, -1)]
        words = pa.concat_arrays([*words, pa.array(itertools.chain.from_iterable(units), pa.string())]).dictionary_encode()
        n, m, of_words = len(plain), len(marked), words.indices.to_numpy(zero_copy_only=False)
        of_words = np.concatenate([of_words[:n], of_words[n : n + 2 * m].reshape(2, m).T.ravel(), of_words[n + 2 * m :]])
        lengths = np.concatenate([np.ones(n, "i8"), np.full(m, 2), np.array([len(u) for u in units], "i8")])
        at = np.cumsum(lengths) - lengths
        unit_of = np.full(len(pieces), -1)
        unit_of[np.concatenate([plain, marked, other])] = np.arange(n + m + len(other))
        sequence = unit_of[codes]
        sequence[starts] = n + m + len(other) + np.arange(len(starts))
        sequence, n_units = sequence[first | rest], np.where(whole, 1, counts)
        each = lengths[sequence]
        return words.dictionary, of_words[_spans(at[sequence], each)], np.add.reduceat(each, np.cumsum(n_units) - n_units)


def _tokens(ranks: dict[bytes, int]) -> tuple:
    """All tokens, their ids, and the ids of the single bytes."""
    import numpy as np

    return pa.array(list(ranks), pa.binary()), np.array(list(ranks.values()), "i8"), np.array([ranks[bytes([b])] for b in range(256)], "i8")


def _distinct_words(pattern: str, sent, max_words: int):
    """The words of a partition that are folded (now and then a word comes again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        tokens, split, met = _tokens(sent.value)[0], Splitter(pattern), np.zeros(0, "u8")
        for batch in batches:
            for piece in _slices(batch, 0, SLICE):
                words = split(pc.coalesce(piece.column(0), pa.scalar("")))[0]
                raw = words.cast(pa.binary())
                words = words.filter(pc.and_(pc.less_equal(pc.binary_length(raw), LONG), pc.invert(pc.is_in(raw, tokens))))
                hashes = _hashes(words.cast(pa.binary()))
                fresh = np.ones(len(hashes), bool) if not len(met) else met[np.minimum(np.searchsorted(met, hashes), len(met) - 1)] != hashes
                yield pa.record_batch({"word": words.filter(pa.array(fresh))})
                met = np.sort(np.concatenate([met, hashes[fresh]])) if len(met) <= max_words else np.zeros(0, "u8")
                pa.default_memory_pool().release_unused()

    return run


def _as_bytes(sent):
    """(hash, ids of the single bytes) of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        id_of = _tokens(sent.value)[2]
        for batch in batches:
            raw = batch.column(0).cast(pa.binary())
            ends = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.binary_length(raw), "i8"))]).astype("i4")
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(id_of[np.frombuffer(b"".join(_listed(raw)), "u1")]))
            yield pa.record_batch({"h": pa.array(_hashes(raw).view("i8")), "word": ids})

    return run


def shared_words(rows: DataFrame, ranks: dict[bytes, int], pattern: str, fold: Column, max_words: int = MAX_WORDS, shared: int = SHARED):
    """(hashes in order, where each one's ids start, all ids): the most widespread words that several partitions hold."""
    import numpy as np

    from tessera.llm.runtime import settle

    sent = rows.sparkSession.sparkContext.broadcast(ranks)
    counted = rows.select("text").mapInArrow(_distinct_words(pattern, sent, max_words), "word string").groupBy("word").agg(F.count("*").alias("n"))
    counted = settle(counted.filter("n > 1"), "bpe-words")
    # the least number of partitions with which at most so many words are left
    least, left = 2, 0
    for n, words in counted.groupBy("n").count().orderBy(F.desc("n")).collect():
        if left + words > shared:
            least = n + 1
            break
        left += words
    # a row a word, 8 + 4 bytes and 4 for each id, of at most SHARED words
    chosen = counted.filter(F.col("n") >= least).select("word").repartition(rows.sparkSession.sparkContext.defaultParallelism * 4)
    spelled = chosen.mapInArrow(_as_bytes(sent), "h long, word array<bigint>")
    table = settle(spelled.select("h", fold.alias("ids")), "bpe-folded").toArrow()
    hashes, ids = table["h"].combine_chunks().to_numpy(zero_copy_only=False), table["ids"].combine_chunks()
    order = np.argsort(hashes)
    lengths = np.asarray(ids.value_lengths(), "i8") if len(ids) else np.zeros(0, "i8")
    flat = np.asarray(ids.flatten(), "<u4") if len(ids) else np.zeros(0, "<u4")
    sorted_ids = flat[_spans((np.cumsum(lengths) - lengths)[order], lengths[order])]
    return hashes[order], np.concatenate([[0], np.cumsum(lengths[order])]).astype("i4"), sorted_ids


CODED = "id long, codes binary, known binary, word array<bigint>, begin boolean"


def _words_first(pattern: str, sent, sent_shared, max_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ranks, split = sent.value, Splitter(pattern)
        tokens, token_ids, byte_ids = _tokens(ranks)
        hashes, starts, shared_ids = sent_shared.value
        code_of: dict[str, int] = {}
        held = 0
        for batch in batches:
            for piece in _slices(batch, 1, SLICE):
                words, positions, counts = split(pa.compute.coalesce(piece.column(1), pa.scalar("")))
                before, code = len(code_of), np.fromiter((code_of.setdefault(w, len(code_of)) for w in _listed(words)), "i8", len(words))
                fresh = words.filter(pa.array(code >= before)).cast(pa.binary())
                sizes = np.asarray(pa.compute.binary_length(fresh), "i8")
                held += int(sizes.sum())
                token = pa.compute.fill_null(pa.compute.index_in(fresh, tokens), -1).to_numpy(zero_copy_only=False)
                is_token = token >= 0
                known: list[bytes | None] = [None] * len(fresh)
                for i, x in zip(np.flatnonzero(is_token).tolist(), token_ids[token[is_token]].tolist(), strict=True):
                    known[i] = x.to_bytes(4, "little")
                for i in np.flatnonzero(~is_token & (sizes > LONG)).tolist():
                    known[i] = merge_long(fresh[i].as_py(), ranks)
                asked = ~is_token & (sizes <= LONG)
                if asked.any() and len(hashes):
                    h = _hashes(fresh.filter(pa.array(asked))).view("i8")
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    found = hashes[at] == h
                    for i, k in zip(np.flatnonzero(asked)[found].tolist(), at[found].tolist(), strict=True):
                        known[i] = shared_ids[starts[k] : starts[k + 1]].tobytes()
                    asked[np.flatnonzero(asked)[found]] = False
                begin, n, m = len(code_of) > max_words or held > MAX_HELD, len(fresh), len(piece)
                spelled = byte_ids[np.frombuffer(b"".join(_listed(fresh.filter(pa.array(asked)))), "u1")]
                ends = np.concatenate([[0], np.cumsum(np.where(asked, sizes, 0)), np.full(m, len(spelled))]).astype("i4")
                folded = pa.ListArray.from_arrays(pa.array(ends), pa.array(spelled), mask=pa.array(np.concatenate([~asked, np.ones(m, bool)])))
                yield pa.record_batch(
                    {
                        "id": pa.concat_arrays([pa.nulls(n, pa.int64()), piece.column(0)]),
                        "codes": pa.concat_arrays([pa.nulls(n, pa.binary()), _binaries(code[positions], counts)]),
                        "known": pa.array(known + [None] * m, pa.binary()),
                        "word": folded,
                        "begin": pa.array([False] * (n + m - 1) + [begin], pa.bool_()),
                    }
                )
                if begin:
                    code_of, held = {}, 0
                pa.default_memory_pool().release_unused()

    return run


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ids) of each document, from its words' codes and the ids of all codes so far."""
    import numpy as np

    none = np.zeros(0, "<u4"), np.zeros(0, "i8")
    flat, lengths = none
    for batch in batches:
        is_doc = batch.column("codes").is_valid().to_numpy(zero_copy_only=False)
        begins = batch.column("begin").to_numpy(zero_copy_only=False)
        turns = np.flatnonzero((is_doc[:-1] & ~is_doc[1:]) | begins[:-1]) + 1
        for low, high in zip([0, *turns.tolist()], [*turns.tolist(), len(is_doc)], strict=True):
            part = batch.slice(low, high - low)
            n_words = int((~is_doc[low:high]).sum())
            if n_words:
                known, folded = part.column("known").slice(0, n_words), part.column("folded").slice(0, n_words)
                n_known = np.asarray(pa.compute.fill_null(pa.compute.binary_length(known), 0), "i8") // 4
                n_folded = np.asarray(pa.compute.fill_null(folded.value_lengths(), 0), "i8")
                each = n_known + n_folded
                new, at = np.empty(each.sum(), "<u4"), np.cumsum(each) - each
                new[_spans(at, n_known)] = np.frombuffer(b"".join(_listed(known.drop_null())), "<u4")
                new[_spans(at, n_folded)] = np.asarray(folded.flatten(), "<u4")
                flat, lengths = np.concatenate([flat, new]), np.concatenate([lengths, each])
            starts = np.cumsum(lengths) - lengths
            for docs in _slices(part.slice(n_words).select(["id", "codes"]), 1, SLICE):
                raw = docs.column(1).to_pylist()
                codes, counts = np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw])
                each = lengths[codes]
                total = np.concatenate([[0], np.cumsum(each)])[np.cumsum(counts)]
                ids = flat[_spans(starts[codes], each)]
                yield pa.record_batch({"id": docs.column(0), "ids": _binaries(ids, np.diff(np.concatenate([[0], total])))})
            if begins[high - 1]:
                flat, lengths = none


def _decoded(pieces_sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    piece = pieces_sent.value.__getitem__
    for batch in batches:
        for part in _slices(batch, 1, SLICE):
            whole = [b"".join(map(piece, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(1).to_pylist()]
            yield pa.record_batch({"id": part.column(0), "ids": part.column(1), "decoded": pa.array(whole, pa.binary())})


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return pieces


def _folded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str, max_words: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fold = F.expr(fold_expression(ranks, "word"))
    sent, sent_shared = context.broadcast(ranks), context.broadcast(shared_words(rows, ranks, pattern, fold, max_words))
    pa.default_memory_pool().release_unused()
    marked = rows.mapInArrow(_words_first(pattern, sent, sent_shared, min(max_words, MAX_CODED)), CODED)
    return marked.withColumn("folded", F.when(F.col("word").isNotNull(), fold)).drop("word")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """Each row's id and ``ids``: its text's token ids as little-endian unsigned 32-bit integers."""
    folded = _folded(docs, ranks, pattern, id_col, text_col, max_words)
    return folded.mapInArrow(_put_together, "id long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Each row's id and ``decoded``: the bytes of its ids' pieces, one after the other; null ids count as none."""
    sent = encoded.sparkSession.sparkContext.broadcast(_pieces(ranks))
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(lambda batches: _decoded(sent, batches), "id long, ids binary, decoded binary").withColumnsRenamed({"id": id_col, "ids": ids_col})


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """``decode`` of what ``encode`` gives, in the worker that put the ids together."""
    sent = docs.sparkSession.sparkContext.broadcast(_pieces(ranks))
    folded = _folded(docs, ranks, pattern, id_col, text_col, max_words)
    return folded.mapInArrow(lambda batches: _decoded(sent, _put_together(batches)), "id long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of each document's ids and of their decoded bytes."""
    return encode_decode(docs, ranks, pattern).select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN)
