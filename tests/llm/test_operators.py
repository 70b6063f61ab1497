"""The training-data operators against brute force, with nulls, empties, ties, repeats, clashing columns and empty tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, pos int, n long, size long"


def docs_of(spark, texts):
    """Documents with odd texts and columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 3) for i, t in enumerate(texts)], DOCS)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été", "naïve", "42", "x,y", "(z)", "don't"]) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    found = [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    return [*found, found[0], found[0], None, "", " ", "\n\n", "  two  spaces\t\n end ", "日本語のテキスト 🙂 12345", "a" * 300, words(rng, 4000), "word"]


def brute_bpe(ranks, text):
    import regex

    out = []
    for w in regex.findall(P.PATTERN, text):
        b = w.encode()
        parts = [b] if b in ranks else [bytes([x]) for x in b]
        while len(parts) > 1:
            best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 40:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_bpe(spark, texts):
    from tessera.llm import byte_bpe as B

    ranks = B.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    df = docs_of(spark, texts)
    got = {r.doc_id: r for r in B.decode(B.encode(df, ranks, P.PATTERN, max_words=50), ranks).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == brute_bpe(ranks, t or ""), i
        assert bytes(got[i].decoded) == (t or "").encode()
    assert B.digests(df.limit(0), ranks, P.PATTERN).count() == 0


def test_bpe_of_long_words(spark):
    from tessera.llm import byte_bpe as B

    ranks, rng = B.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), random.Random(9)
    for k in (1, 2, 7, 60, 400):
        word = "".join(rng.choice("aabetthié") for _ in range(k))
        b = word.encode()
        assert np.frombuffer(B.merge_long(b, ranks), "<u4").tolist() == brute_bpe(ranks, word) or b in ranks
    texts = ["a" * 1024, "a" * 1025, "".join(rng.choice("etaoin") for _ in range(3000)) + " end", "b" * 300_000]
    got = {r.doc_id: r for r in B.decode(B.encode(docs_of(spark, texts), ranks, P.PATTERN), ranks).collect()}
    for i, t in enumerate(texts[:3]):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == brute_bpe(ranks, t)
    assert all(bytes(got[i].decoded) == t.encode() for i, t in enumerate(texts))


def test_bpe_splits_letters_without_the_pattern():
    import pyarrow as pa
    import regex
    from tessera.llm import byte_bpe as B

    split, seen = B.Splitter(P.PATTERN), []
    find = split._find
    split._find = lambda text: seen.append(text) or find(text)
    odd = ["", " ", "two  spaces y", "tab\tand line\nand more", "a\u00a0b \u2003c", "日本 語, ẞa ªb", "it's don't, x., 5 a5 a_b \u0300a", "end, ", "end,\n", ". a. .", "ñ"]
    texts = ["Señor árbol, plain words; ǅungla: ɏ! " * 3 + "fin", *odd, None, *(a + b for a in odd for b in odd)]
    words, positions, counts = split(pa.array([t or "" for t in texts]))
    got = np.split(np.array(words.to_pylist(), object)[positions], np.cumsum(counts)[:-1])
    assert [x.tolist() for x in got] == [regex.findall(P.PATTERN, t or "") for t in texts]
    assert not {" árbol,", " plain", " words;", " ǅungla:", " ɏ!"} & set(seen) and " a5" in seen
    assert len(set(words.to_pylist())) == len(words)


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, base[:10] + 0.05 * rng.normal(size=(10, 8)), base[:3], -base[:2]]))]
    odd = [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] + [1.0] * 7, 1), (103, [None] + [1.0] * 7, 1), (104, [1.0, 2.0], 1), (105, [float("inf")] * 8, 1), (106, [], 1)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), rows + odd


def test_topk(spark):
    from tessera.llm.topk_search import top_k

    df, rows = vectors(spark)
    got = top_k(df, F.col("vec_id") % 5 == 0, 3).orderBy("query_id", "rank").collect()
    v = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e, _ in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in sorted(v):
        if q % 5 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[o])), o) for o in v if o != q and len(v[o]) == len(v[q]))[:3]
            want += [(q, k + 1, o, -m) for k, (m, o) in enumerate(s)]
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == want
    assert top_k(df.limit(0), F.lit(True), 3).count() == 0


def test_topk_of_repeated_rows(spark, monkeypatch):
    from tessera.llm import topk_search

    monkeypatch.setattr(topk_search, "BUCKET", 7)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 6)))]
    rows += [rows[0], rows[0], rows[5], (5, rng.normal(size=6).tolist()), (10, rng.normal(size=6).tolist()), rows[33], rows[34], (35, rows[34][1])]
    got = topk_search.top_k(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, score int, bucket int, pos int"), F.col("vec_id") % 5 == 0, 5).orderBy("query_id", "rank").collect()
    v = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows]
    want = []
    for q in sorted({i for i, _ in v if i % 5 == 0}):
        best = {}
        for o, m in ((o, sum(a * b for a, b in zip(x, y))) for i, x in v if i == q for o, y in v if o != q):
            best[o] = max(m, best.get(o, m))
        s = sorted((-m, o) for o, m in best.items())[:5]
        want += [(q, k + 1, o, -m) for k, (m, o) in enumerate(s)]
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == want


def test_embedding_dedup(spark):
    from tessera.llm.embedding_dedup import near_duplicates

    df, rows = vectors(spark)
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    sound = {i: np.float32(e).astype("f8") for i, e, _ in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    links = {i: set() for i, _, _ in rows}
    for i in sound:
        for j in sound:
            if i != j and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] >= 0.9 * np.linalg.norm(sound[i]) * np.linalg.norm(sound[j]):
                links[i].add(j)
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), min(seen) == i)
    assert near_duplicates(df.limit(0)).count() == 0


def test_sharding(spark, texts):
    from tessera.llm.sharding import best_fit_decreasing, shard

    df = docs_of(spark, texts + ["small"] * 200)
    got = shard(df, 5).collect()
    assert len(got) == df.count()
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    assert all(r.text_crc32 == zlib.crc32(raw[r.doc_id]) and r["size"] == len(raw[r.doc_id]) + 8 for r in got if r.doc_id in raw)
    assert shard(df.limit(0), 5).count() == 0
    rng = random.Random(5)
    items = sorted((rng.randrange(1, 60) for _ in range(300)), reverse=True)
    runs, bins = best_fit_decreasing(sorted(Counter(items).items(), reverse=True), 100)
    free = []
    for x in items:  # plain best fit
        fits = [i for i, f in enumerate(free) if f >= x]
        i = min(fits, key=lambda i: free[i]) if fits else len(free)
        free += [100] if i == len(free) else []
        free[i] -= x
    assert bins == len(free)


def test_sharding_keeps_groups_whole(spark):
    from tessera.llm.sharding import shard

    rng = random.Random(6)
    single = [words(rng, 30) for _ in range(200)]
    most_of_one = [t for i in range(4) for t in [f"group {i} of most of a shard " * 4] * 100]
    texts = [*single, *most_of_one, *["more than a shard " * 9] * 160, *[None] * 20]
    total = sum(len((t or "").encode()) + 8 for t in texts)
    share = -(-total // 7)
    got = shard(docs_of(spark, texts), 7).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    homes, sizes = {}, Counter()
    for r in got:
        homes.setdefault(texts[r.doc_id], Counter())[r.shard] += 1
        sizes[r.shard] += r["size"]
    for t, found in homes.items():
        each = len((t or "").encode()) + 8
        assert len(found) == -(-found.total() // (share // each)), (t, found)
    assert len(homes[texts[200]]) == 1 and len(homes[texts[600]]) == 2
    assert len(sizes) == 7 and max(sizes.values()) < 1.02 * share


def test_line_dedup(spark):
    from tessera.llm.line_dedup import dedup

    texts = ["a long enough line\nshort\nanother long line", "  A LONG enough line\t\nown line of two", None, "", "short\nshort", "another long line\nanother long line", "x\n\n", "a long enough line"]
    df = docs_of(spark, texts)
    first = {}
    keys = [[x.strip("\t\n\x0b\x0c\r ").lower() for x in (t or "").split("\n")] for t in texts]
    for i, k in enumerate(keys):
        for x in k:
            first.setdefault(x, i)
    got = {r.doc_id: r for r in dedup(df).collect()}
    for i, t in enumerate(texts):
        kept = [x for x, k in zip((t or "").split("\n"), keys[i]) if len(k) < 10 or first[k] == i]
        assert got[i].kept_text == "\n".join(kept) and got[i].n_lines == len(keys[i]) and got[i].n_dropped == len(keys[i]) - len(kept)
        runs = np.frombuffer(bytes(got[i].keep_bitmap), ">u4").reshape(-1, 2)
        assert runs[:, 1].sum() == len(kept)
    assert dedup(df.limit(0)).count() == 0
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(None, "a long enough line", "", "", 0, "", 0, 0, 0)], DOCS))
    again = dedup(twice).collect()
    assert len(again) == 17 and [r.n_dropped for r in again if r.doc_id is None] == [1]


def test_jaccard(spark):
    from tessera.llm.jaccard_join import similar_groups

    rng = random.Random(2)
    base = [[f"w{rng.randrange(3000)}" for _ in range(80)] for _ in range(12)]
    rows = [" ".join(b) for b in base]
    for b in base[:6]:
        for k in (1, 2, 4):
            c = list(b)
            for _ in range(k):
                c[rng.randrange(80)] = "changed"
            rows.append(" ".join(c))
    rows += [rows[0], rows[0].upper(), None, "", "one two three", "One two\tthree", "one two three four five", " \n "]

    def sets(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    s = [sets(t) for t in rows]
    home = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                    home[i] = home[j] = min(home[i], home[j])
    got = {r.doc_id: r for r in similar_groups(docs_of(spark, rows)).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(rows))] == [(len(s[i]), home[i]) for i in range(len(rows))]
    assert similar_groups(docs_of(spark, rows).limit(0)).count() == 0


def test_toxicity(spark):
    from tessera.llm import toxicity as X

    rng = random.Random(4)
    toxic = [rng.random() < 0.3 for _ in range(300)]
    rows = [words(rng, 60) + (" you vile filth and vermin you " + words(rng, 20) if t else "") for t in toxic]
    df = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = X.fit(df, labels)
    got = {r.doc_id: r.toxic_score for r in X.score(df, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == toxic[i] for i in held) >= 0.95 * len(held)
    odd = X.score(docs_of(spark, [None, "", "a" * 9]), model).collect()
    assert all(0 <= r.toxic_score < 0.3 and not r.toxic_passages for r in odd)
    assert X.score(df.limit(0), X.fit(df, labels.limit(0))).count() == 0


def test_segments_are_maximal():
    from tessera.llm.toxicity import segments

    assert segments([(0, 4.0), (2, 3.0), (9, 5.0)], neutral=-1.0) == [(0, 2, 6.0), (9, 9, 5.0)]
    assert segments([]) == []
    rng = random.Random(6)
    for _ in range(200):
        s = [rng.choice([-1.0, -1.0, 2.0, 3.0]) for _ in range(30)]
        found = segments([(i, x) for i, x in enumerate(s) if x > 0], neutral=-1.0)
        best = max((sum(s[i : j + 1]) for i in range(30) for j in range(i, 30)), default=0)
        if found:
            assert max(f[2] for f in found) == best
            assert all(sum(s[a : b + 1]) == v for a, b, v in found)


def test_warc(spark, tmp_path):
    from tessera.llm import warc as W

    rows = [(3, "http://a/é x", "same"), (1, None, "same"), (2, "", None), (4, "u", ""), (5, "u", "own é"), (None, "u", "same"), (1, "u", "same"), (9, "u", "big" * 100_000)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    archives = W.write_archives(pages)
    got = W.read_archives(archives).collect()
    want = Counter((p, "response" if p == {"same": 1, "": 2}.get(h or "", p) else "revisit", len((h or "").encode()), W.base32_sha1((h or "").encode())) for p, _, h in rows)
    assert Counter((r.page_id, r.record_type, r.payload_bytes, r.payload_digest) for r in got) == want
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {1, 2}
    W.save_archives(archives, f"file://{tmp_path}/w")
    again = W.read_archives(W.load_archives(spark, f"{tmp_path}/w"))
    assert again.count() == len(rows) and again.filter("page_id = 5").first().payload.decode() == "own é"
    one = archives.first().content
    broken = spark.createDataFrame([(bytearray(one[:-9]),)], "content binary")
    assert W.read_archives(broken, strict=False).filter("problem IS NOT NULL").count() == 1
    assert W.read_archives(W.write_archives(pages.limit(0))).count() == 0


def test_token_counts(spark):
    from tessera.llm.runtime import table_path
    from tessera.llm.token_counts import TokenRollup

    schema = "op string, doc_id long, tokenizer string, source string, lang string, n_tokens long"
    rng, live = random.Random(7), {}
    rollup = TokenRollup(spark, table_path(spark, "rollup-test"))
    assert rollup.totals().count() == 0
    for b in range(4):
        batch = {}
        for _ in range(40):
            k = (rng.randrange(30), rng.choice(["a", "b", None]))
            batch[k] = (rng.choice(["insert", "revise", "delete"]), *k, rng.choice(["s", None]), "en", rng.randrange(100))
        changes = spark.createDataFrame([*batch.values(), ("insert", None, "a", "s", "en", 5)], schema)
        assert rollup.commit(f"batch/{b}", changes) and not rollup.commit(f"batch/{b}", changes)
        for k, (op, _, tok, src, lang, n) in batch.items():
            live.pop(k, None)
            if op != "delete":
                live[k] = (src, lang, tok, n)
    want = Counter(), Counter()
    for src, lang, tok, n in live.values():
        want[0][src, lang, tok] += 1
        want[1][src, lang, tok] += n
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == {k: (want[0][k], want[1][k]) for k in want[0]}


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    from tessera.llm.packing import pack

    texts = [*texts, "a <|endoftext|> b"]
    path = P.path("byte_bpe_50k.json")
    got = pack(docs_of(spark, texts), path, window=256, open_windows=3).collect()
    tok, by, seq = Tokenizer.from_file(path), {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)
    assert pack(docs_of(spark, texts).limit(0), path).count() == 0


def brute_passages(scores, cost):
    """Maximal segments by their definition: the best segment, then those on its left and on its right."""
    s = [cost if x is None else x for x in scores]

    def within(a, b):
        best, low, at, total = None, 0.0, a, 0.0
        for i in range(a, b):
            total += s[i]
            if total > low and (best is None or total - low > best[0] + 1e-12):
                best = total - low, at, i
            if total < low:
                low, at = total, i + 1
        return [] if best is None else [*within(a, best[1]), best, *within(best[2] + 1, b)]

    return within(0, len(s))


def brute_toxic(model, text):
    import math

    from tessera.llm import toxicity as X

    found = X.WORD.findall((text or "").lower())
    scores = [max((model.scores[f] for f in X.features(w) if f in model.scores), default=None) for w in found]
    bits = [model.scale * x[0] - math.log(max(model.volume * len(found), 1e-9)) for x in brute_passages(scores, X.NEUTRAL)]
    real = [b for b in bits if b > -math.log(X.E_MAX)]
    return X.probability(model, max([0.0, *bits]), sum(real), len(real))


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from tessera.llm import toxicity as X

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = X.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    texts = {i: t for i, t in sorted(texts.items()) if brute_toxic(model, t) < 0.3}

    ws = "\t\n\x0b\x0c\r "
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = {}
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            first.setdefault(x.strip(ws).translate(lower), i)
    texts = {i: t if t is None else "\n".join(x for x in t.split("\n") if len(k := x.strip(ws).translate(lower)) < 10 or first[k] == i) for i, t in texts.items()}

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, home = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            home[i] = home[j] = min(home[i], home[j])
    kept = {i: t for i, t in texts.items() if home[i] == i}

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in kept.items()}
    pieces, sequences = {}, {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_pipeline_stages_on_odd_rows(spark):
    """Each stage by itself: nulls, repeated ids and an empty table keep the columns of documents."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, None, "en", None, 0), (7, "", None, "s", None), (8, "a line that is long enough\nx", "en", "s", 28), (None, "a line that is long enough", "en", "s", 26)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.select([F.col(f.name).cast(f.dataType) for f in docs.schema])
    # names that operators use for their own columns, and a very long text
    clash = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(9).cast(docs.schema["doc_id"].dataType), "text": F.lit("word " * 200_000)}))
    clash = clash.withColumns({c: F.lit("own") for c in ("toxic_score", "kept_text", "n_dropped", "id", "row", "token", "n")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, sf_dir)
        assert out.columns == clash.columns and out.count() == 6, name
        assert {tuple(r) for r in out.select("toxic_score", "kept_text", "n_dropped", "id", "row", "token", "n").collect()} == {("own",) * 7}, name
    for rows in (odd, odd.limit(0)):
        n = rows.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, sf_dir)
            assert out.columns == docs.columns, name
            assert out.count() == n, name
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()
        starts = [r for r in packed if r.start == 0]
        assert len(starts) == n and sum(r.length for r in packed) == sum(r.doc_tokens for r in starts)


def test_token_counts_query_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    from tessera.llm.token_counts import op9_token_counts

    texts = ["one two  three\n", "same text", "same text", None, "", "same text", "a <|endoftext|> b", "long " * 30_000]
    rows = [(i, t, ["en", "de", None][i % 3], "s" if i % 2 else None, len(t or ""), 1) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int"
    for name, some in (("full", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        tok, first, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}, {}
        for i, t, lang, source, *_ in some:
            if first.setdefault(t or "", i) != i:
                continue
            for version, n in (("byte_bpe_50k", len(tok.encode(t or "", add_special_tokens=False).ids)), ("words", len((t or "").split()))):
                docs, tokens = want.get((source, lang, version), (0, 0))
                want[source, lang, version] = docs + 1, tokens + n
        got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in op9_token_counts(spark, f"{tmp_path}/{name}").collect()}
        assert got == want


def test_embedding_dedup_of_repeated_and_null_ids(spark):
    from tessera.llm.embedding_dedup import near_duplicates

    near, far = [1.0, 0.05, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, near), (2, far), (None, near), (None, None), (3, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 9, 9) for i, v in rows], "vec_id long, embedding array<float>, n_links int, root int")
    got = Counter(tuple(r) for r in near_duplicates(df).collect())
    assert got == Counter({(1, 3, 1, True): 2, (2, 3, 1, False): 1, (2, 0, 2, True): 1, (None, 3, 1, False): 1, (None, 0, None, False): 1, (3, 0, 3, True): 1})


def test_embedding_dedup_recall(spark):
    from tessera.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 32))
    v = np.concatenate([base, *(base[k : k + 200] + s * rng.normal(size=(200, 32)) for k, s in ((0, 0.1), (100, 0.2), (300, 0.3), (300, 0.35))), base[:1] + 0.2 * rng.normal(size=(300, 32))]).astype("f4")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    unit = v.astype("f8") / np.linalg.norm(v.astype("f8"), axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(v))])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
