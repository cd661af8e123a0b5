"""Each operator against brute force on the same rows, and on an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from minutary.llm import common, decontaminate, lm_score, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, token_files, units


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def ids_of(name, sample):
    tok = Tokenizer.from_file(units.public_path(name))
    return [(i, e.ids) for (i, _), e in zip(sample, tok.encode_batch([t or "" for _, t in sample], add_special_tokens=False))]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_stupid_backoff(docs, empty, sample):
    words = [(i, (t or "").encode().split()) for i, t in sample]
    uni, bi = Counter(), Counter()
    for _, w in words:
        uni.update(w)
        bi.update(zip(w, w[1:]))
    n, want = sum(uni.values()), []
    for i, w in words:
        own, pair, s = Counter(w), Counter(zip(w, w[1:])), 0.0
        for k, x in enumerate(w):
            if k and bi[w[k - 1], x] > pair[w[k - 1], x]:
                s += math.log((bi[w[k - 1], x] - pair[w[k - 1], x]) / (uni[w[k - 1]] - own[w[k - 1]]))
            else:
                s += (math.log(0.4) if k else 0) + math.log(max(uni[x] - own[x], 1) / max(n - len(w), 1))
        want.append((i, len(w), round(s, 4)))
    found = got(lm_score.score(docs), "doc_id", "n_tokens", "log_score")
    assert [x[:2] for x in found] == [x[:2] for x in sorted(want)]
    assert np.allclose([x[2] for x in found], [x[2] for x in sorted(want)], atol=2e-4)
    assert lm_score.score(empty).count() == 0


def test_totals_are_not_broadcast(docs, monkeypatch):
    made = []
    monkeypatch.setattr(common, "final", lambda df, *a: made.append(df) or df)
    lm_score.score(docs)
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_higher_order_scores_are_finite_and_use_trigrams(docs):
    two, three = (dict(got(lm_score.score(docs, order=k), "doc_id", "log_score")) for k in (2, 3))
    assert all(map(math.isfinite, three.values())) and two != three


def bag(t):
    w = (t or "").split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def classes(sample):
    ids, bags = [i for i, _ in sample], [bag(t) for _, t in sample]
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            same = (sample[a][1] or "") == (sample[b][1] or "")
            low, high = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if same or high and low >= 0.8 * high:
                up[top(a)] = top(b)
    least = defaultdict(lambda: 1 << 60)
    for k, i in enumerate(ids):
        least[top(k)] = min(least[top(k)], i)
    return sorted((i, least[top(k)]) for k, i in enumerate(ids))


@pytest.mark.parametrize("small", [8, 0])
def test_near_classes(docs, empty, sample, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)  # 0: every torn bucket is searched as a whole
    assert got(near_dedup.near_classes(docs), "doc_id", "class_id") == classes(sample)
    assert near_dedup.near_classes(empty).count() == 0


def test_chunked_buckets(docs, sample, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 0)
    monkeypatch.setattr(near_dedup, "CHUNK", 2)
    assert got(near_dedup.near_classes(docs), "doc_id", "class_id") == classes(sample)


def test_signatures_estimate_weighted_jaccard():
    rng, m = np.random.default_rng(3), 4096
    a, b = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
    doc, shingle = np.repeat([0, 1], 300), np.tile(np.arange(1, 301, dtype=np.uint64), 2)
    w = np.concatenate((a, b))
    keep = w > 0
    sig = near_dedup.signatures(doc[keep], shingle[keep], w[keep], 2, m)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / m)


def test_links_across_components_equal_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 40, 120)
    members = []
    for k in range(60):
        x = base.copy()
        cut = rng.integers(0, 40)
        x[rng.choice(120, cut, replace=False)] = rng.integers(1, 1 << 40, cut)
        x, w = np.unique(x.astype("<u8"), return_counts=True)
        members.append({"node": bytes([k]), "root": bytes([k]), "bag": x.tobytes(), "weights": w.astype("<u4").tobytes()})
    sets = [Counter(dict(zip(np.frombuffer(m["bag"], "<u8").tolist(), np.frombuffer(m["weights"], "<u4").tolist()))) for m in members]
    up = list(range(60))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    def groups():
        g = defaultdict(set)
        for k in range(60):
            g[top(k)].add(k)
        return sorted(map(sorted, g.values()))

    for a in range(60):
        for b in range(a):
            if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                up[top(a)] = top(b)
    want = groups()
    up[:] = range(60)
    for a, b in near_dedup.cross_links(members, 0.8):
        up[top(a[0])] = top(b[0])
    assert groups() == want and 1 < len(want) < 60


def rows_joined(spark, run):
    """Rows that all joins make while run() works, by Spark's own metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, total = store.executionsCount(), 0
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = store.executionsList()
    for k in range(before, done.size()):
        i = done.apply(k).executionId()
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for node in (nodes.apply(n) for n in range(nodes.size())):
            if "Join" in node.name():
                found = [m for m in (node.metrics().apply(n) for n in range(node.metrics().size())) if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
                total += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in found)
    return total


def test_components_read_all_links_once(spark):
    """A group of near copies with 24 hubs and a chain: the links are not joined anew in every round."""
    name, rng = lambda k: hashlib.sha256(str(k).encode()).digest()[:16], random.Random(2)
    chain = sorted(name(k) for k in range(1000, 1200))
    edges = {(min(x, y), max(x, y)) for k in range(400) for h in rng.sample(range(400), 24) for x, y in [(name(k), name(h))] if x != y}
    edges |= set(zip(chain, chain[1:])) | {(name(2000), name(2001))}
    links = common.settle(spark.createDataFrame(sorted(edges), "a binary, b binary"), "test", [])
    found = []
    assert 0 < rows_joined(spark, lambda: found.extend(near_dedup.components(links, []).collect())) < 3 * len(edges)
    want = {name(k): min(name(n) for n in range(400)) for k in range(400)} | {n: chain[0] for n in chain} | {name(k): min(name(2000), name(2001)) for k in (2000, 2001)}
    assert {bytes(r.node): bytes(r.root) for r in found} == want and len(found) == len(want)


def test_components_go_on_from_known_ones(spark):
    rng = random.Random(4)
    edges = [(x.to_bytes(2, "big"), y.to_bytes(2, "big")) for x, y in (rng.sample(range(300), 2) for _ in range(200))]
    frame = lambda e: spark.createDataFrame(e, "a binary, b binary")
    whole = got(near_dedup.components(frame(edges), []), "node", "root")
    known = near_dedup.components(frame(edges[:120]), [])
    assert got(near_dedup.components(frame(edges[120:]), [], known), "node", "root") == whole
    assert got(near_dedup.components(frame([]), [], known), "node", "root") == got(known, "node", "root")
    assert got(near_dedup.components(frame(edges), [], near_dedup.components(frame([]), [])), "node", "root") == whole


def test_one_of_each(docs, sample):
    kept = near_dedup.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in classes(sample)}) and kept.columns == docs.columns


def test_token_counts(docs, empty, sample):
    want = sorted((i, len((t or "").encode()), len(e), len(e) > 1024) for (i, t), (_, e) in zip(sample, ids_of("byte_bpe_50k.json", sample)))
    assert got(token_counts.count_tokens(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(empty).count() == 0


@pytest.mark.parametrize("kind,name", [(units.ByteUnits, "byte_bpe_50k.json"), (units.WordUnits, "word_bpe_49k.json")])
def test_units_equal_the_library(kind, name):
    import random

    r = random.Random(1)
    parts = ["a", "B", "é", "Σ", "'s", "'", ".", " ", "  ", "\n", "\t", ",", "_", "<|endoftext|>", "<|startoftext|>", "1", "́", "\x1c", "\0", "!?", "　", "中", "İ", "\xa0", " the", "The", "ﬁ", "😀", "\x85", "don't"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    cache, tok = kind(units.public_path(name), 4, limit=3000), Tokenizer.from_file(units.public_path(name))
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert [b"".join(v) for v in cache.documents(part)] == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(part, add_special_tokens=False)]


def test_token_files(docs, empty, sample, spark):
    want, start = [], 0
    for i, e in sorted(ids_of("byte_bpe_50k.json", sample)):
        want.append((i, start, len(e) + 1, crc([*e, 0])))
        start += len(e) + 1
    assert got(token_files.round_trip(docs), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_files.round_trip(empty).count() == 0


@pytest.mark.parametrize("shard_bytes", [64 << 20, 4000])
def test_keyed_access(docs, sample, monkeypatch, shard_bytes):
    monkeypatch.setattr(token_files, "SHARD_BYTES", shard_bytes)
    manifest = token_files.write_shards(docs, common.scratch(docs.sparkSession, "tokens"), units.public_path("byte_bpe_50k.json"), 0, 50_257).collect()
    want, seen = dict(ids_of("byte_bpe_50k.json", sample)), 0
    for m in manifest:
        shard = token_files.ShardReader(m.uri)
        at = shard.find(shard.keys)
        assert (shard.find(pa.array(range(-5, 0))) == -1).all()
        for key, record in zip(shard.keys.to_pylist(), at.tolist()):
            assert np.frombuffer(shard.read(record, record + 1), "<u2").tolist() == [*want[key], 0]
            seen += 1
    assert seen == len(sample) and (shard_bytes > 4000 or len(manifest) > 4)


@pytest.mark.parametrize("shard_bytes", [64 << 20, 3000])
def test_token_files_with_keys_of_other_types(docs, sample, spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(token_files, "SHARD_BYTES", shard_bytes)
    rows = [(None if i % 5 == 0 else f"key/{i % 40}", t) for i, t in sample]
    want, start = [], 0
    tokens = [(k, [*e, 0]) for (k, _), (_, e) in zip(rows, ids_of("byte_bpe_50k.json", sample))]
    found = token_files.round_trip(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()
    assert sorted((r.doc_id or "", r.n_tokens, r.ids_crc32) for r in found) == sorted((k or "", len(e), crc(e)) for k, e in tokens)
    at = sorted(found, key=lambda r: r.start)
    assert [r.doc_id or "" for r in at] == sorted(k or "" for k, _ in tokens)
    assert all(r.start + r.n_tokens == n.start for r, n in zip(at, at[1:])) and at[0].start == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 1 << 62, 5000).astype(np.uint64)
    h = token_files.PerfectHash.build(np.unique(keys))
    assert sorted(h(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))


def covered(sample, length):
    raw = [(t or "").encode() for _, t in sample]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    for (i, _), b in zip(sample, raw):
        on = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                on[k] += 1
                on[k + length] -= 1
        on = np.cumsum(on)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], on.astype(int)))) == 1).sum())
        yield i, len(b), int(on.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~on].tobytes()).hexdigest()


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_repeated_passages(docs, empty, sample, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)  # 500: large blocks are split by anchor
    assert got(suffix_dedup.removals(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(covered(sample, 200))
    assert suffix_dedup.removals(empty).count() == 0


def test_texts_that_share_a_number_are_all_searched(docs, sample, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(suffix_dedup, "number", lambda sha: F.ascii(sha).cast("long"))  # sixteen numbers for all texts
    assert got(suffix_dedup.removals(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(covered(sample, 200))


@pytest.mark.parametrize("keys", [[1.0, math.nan, math.nan], [-0.0, 0.0, 2.5], [None, None, math.nan, math.nan, math.nan], [math.inf, math.nan]])
def test_index_of_float_keys_ends(keys):
    archive = token_files._index(pa.array(keys, pa.float64()), list(range(len(keys) + 1)))
    assert len(archive) > 0


def test_keys_out_of_order_are_an_error():
    with pytest.raises(ValueError, match="hash alike"):
        token_files._index(pa.array(["a", "b", "a"]), [0, 1, 2, 3])


def test_an_anchor_of_many_texts_is_not_one_index(spark, monkeypatch):
    import random

    whole = suffix_dedup.RunIndex

    def small(segments):
        assert sum(map(len, segments)) <= 5 * 4000
        return whole(segments)

    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "RunIndex", small)
    r = random.Random(4)
    make = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passage = make(300)
    # passages whole, cut at either end, and twice in a text, each among words of its own
    rows = [(k, make(90) + passage[(k % 3) * 7 : 300 - (k % 5) * 6] + make(90) + (passage if k % 50 == 0 else "")) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix_dedup.removals(table), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(covered(rows, 200))


def test_matching_statistics_equal_brute_force():
    r = np.random.default_rng(2)
    parts = [bytes(r.integers(97, 100, 40)) for _ in range(6)]
    segments = [b"".join(parts[k] for k in r.integers(0, 6, 5)) for _ in range(7)] + [b"\0\0\0a", b"a", b"aaaaaaaaaa"]
    index = suffix_dedup.RunIndex(segments)
    assert index.run_lengths.sum() == len(index.text) and len(index.symbols) == len(index.head_place) == len(index.end_place)
    for length in (3, 8, 40, 60):
        seen = Counter(s[k : k + length] for s in segments for k in range(len(s) - length + 1))
        for s, spans in zip(segments, index.marked(length)):
            on = np.zeros(len(s), bool)
            for k in range(len(s) - length + 1):
                if seen[s[k : k + length]] > 1:
                    on[k : k + length] = True
            mine = np.zeros(len(s), bool)
            for b, e in spans:
                mine[b:e] = True
            assert (on == mine).all()


def test_stripped_documents(docs, passage):
    out = suffix_dedup.strip_documents(docs)
    assert out.columns == docs.columns and not any(passage in (r.text or "") for r in out.collect())


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, docs, empty, sample, passage):
    bench = [(1, passage), (20, " ".join(passage.split()[5:25])), (3, "one"), (4, None), (5, "..."), (6, "never seen words here at all in this table of texts")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    windows = [(i, w[k : k + 10]) for i, t in bench for w in [words(t)] if w for k in range(max(1, len(w) - 9))]
    want = []
    for i, t in sample:
        w, hit, items = words(t), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    items.add(str(item))
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    cols = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    assert got(decontaminate.scan(docs, table), *cols) == sorted(want) and any(x[-1] for x in want)
    assert decontaminate.scan(empty, table).count() == 0
    assert got(decontaminate.scan(docs, table.limit(0)), "n_hit") == [(0,)] * len(sample)
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, table).collect()) == sorted(x[0] for x in want if not x[-1])


def test_large_vocabularies_and_proximity(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red big fox runs"), (2, "red very big fox runs"), (3, "fox big red")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "red big fox")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.scan(docs, bench).filter("contaminated").collect()] == [1]
    assert sorted(r.doc_id for r in decontaminate.scan(docs, bench, slop=1).filter("contaminated").collect()) == [1, 2]
    assert got(decontaminate.scan(docs, bench, slop=1), "doc_id", "n_hit") == [(1, 3), (2, 4), (3, 0)]
    monkeypatch.setattr(decontaminate, "MAX_VOCABULARY", 1)
    assert [r.doc_id for r in decontaminate.scan(docs, bench).filter("contaminated").collect()] == [1]


def test_packing(docs, empty, sample):
    want = {i: [*e, 1] for i, e in ids_of("word_bpe_49k.json", sample)}
    rows = got(packing.pack(docs, size=256), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    total, sequences = Counter(), defaultdict(list)
    for i, start, n, c, all_, q, at in rows:
        assert 0 < n <= 256 and all_ == len(want[i]) and c == crc(want[i][start : start + n])
        total[i] += n
        sequences[q].append((at, n))
    copies = Counter(i for i, _ in sample)
    assert all(total[i] == copies[i] * len(e) for i, e in want.items())
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 256
    assert packing.pack(empty).count() == 0


def test_histogram_places_every_piece():
    r = np.random.default_rng(4)
    for _ in range(20):
        counts = Counter(r.integers(1, 65, r.integers(1, 3000)).tolist())
        used = Counter()
        for pattern, n in packing.pack_histogram(counts, 64):
            assert sum(pattern) <= 64
            used.update({k: v * n for k, v in Counter(pattern).items()})
        assert used == counts


def test_shards(docs, empty, sample):
    rows = got(sharding.shard_by_bytes(docs, 7), "doc_id", "size", "text_crc32", "shard", "slot")
    assert [r[:3] for r in rows] == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in sample)
    assert [r[3] for r in rows] == sorted(r[3] for r in rows)
    whole, start = sum(r[1] for r in rows), 0
    for r in rows:
        assert r[3] == min(6, (2 * start + r[1]) * 7 // (2 * whole))
        start += r[1]
    for s in range(7):
        assert sorted(r[4] for r in rows if r[3] == s) == list(range(sum(r[3] == s for r in rows)))
    assert sharding.shard_by_bytes(empty).count() == 0


def measures(t):
    t = t or ""
    w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, rep = Counter(zip(*[w[k:] for k in range(5)])), [0] * len(w)
    for k in range(len(w) - 4):
        if seen[tuple(w[k : k + 5])] > 1:
            rep[k : k + 5] = [1] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(rep), len(w) < 10 or 100 * sum(rep) > 20 * len(w)


def test_quality(spark, docs, empty, sample):
    rows = got(quality.score_documents(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows == sorted((i, *measures(t)) for i, t in sample)
    assert quality.score_documents(empty).count() == 0 and quality.filter_documents(docs).columns == docs.columns
    clean = "This sentence holds a dozen plain words so that nothing speaks against it today."
    bad = ["| ".join(clean.split()), clean.upper(), clean.replace(" ", "!! "), " ".join(x for w in "abcdefg" for x in [w * 3] * 4)]
    table = spark.createDataFrame(list(enumerate([clean, *bad])), "doc_id long, text string")
    assert got(quality.score_documents(table), "doc_id", "kept") == [(0, True)] + [(k, False) for k in range(1, 5)]


def test_toxicity_is_learned_from_labels_in_each_language(spark, tmp_path):
    import random

    import corpus_pipeline

    r, rows, labels = random.Random(9), [], []
    for lang, marks in {"en": ("idiot", "scum"), "de": ("achlichung", "achlichkeit"), "fr": ("réeuxment", "réêou"), "es": ("bomenteja", "bocoos")}.items():
        pool = [lang + "".join(r.choice("aeiourstlnm") for _ in range(r.randint(2, 6))) for _ in range(300)]
        for k in range(80):
            w = [r.choice(pool) for _ in range(60)]
            if k % 4 == 0:
                w[20], w[40] = marks
            rows.append((len(rows), " ".join(w), lang))
            if k >= 8:  # the first rows of a language have no label
                labels.append((rows[-1][0], 1, int(k % 4 == 0)))
    spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = {x.doc_id for x in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()}
    for lang in ("en", "de", "fr", "es"):
        ids = [i for i, _, x in rows if x == lang]
        assert not kept.intersection(ids[::4]), lang
        assert kept.issuperset(set(ids) - set(ids[::4])), lang
    assert quality.fit_lexicon(docs, spark.createDataFrame([], "doc_id long, toxic int")) == []


def test_rule_order_follows_rejections_per_cost(spark, monkeypatch):
    from pyspark.sql import functions as F

    slow = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(0), lambda a, x: a + F.regexp_count("text", F.concat(F.lit("w+"), x.cast("string")))) >= 0
    monkeypatch.setattr(quality, "REPEATS", 100)
    words = "ten plain words that stand in a row for once"
    rules = [quality.Rule("never", F.lit(False)), quality.Rule("slow", slow), quality.Rule("often", F.col("n_words") > 0), quality.Rule("same", F.col("n_words") > 1)]
    table = spark.createDataFrame([(words,)] * 50, "text string")
    # what "often" leaves nothing to comes after it in the given order
    assert [[r.name for r in quality.order_rules(table, rules)] for _ in range(4)] == [["often", "never", "slow", "same"]] * 4
    # of rules that reject the same rows the second is worth nothing any more
    half = [quality.Rule("a", F.col("text").startswith("a")), quality.Rule("a too", F.col("text").startswith("a ")), quality.Rule("b", F.col("text").startswith("b"))]
    table = spark.createDataFrame([("a " + words,)] * 60 + [("b " + words,)] * 20, "text string")
    assert [r.name for r in quality.order_rules(table, half, costs=[1.0, 1.0, 1.0])] == ["a", "b", "a too"]


def test_quality_order_is_stable(spark):
    table = common.table(spark, "/root/testdata/sf0.01", "documents")
    rules = quality.cascade_rules()
    assert len({tuple(r.name for r in quality.order_rules(table, rules)) for _ in range(10)}) == 1


def test_null_ids(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta " * 5, "one two three four five six seven eight nine ten " * 6
    docs = spark.createDataFrame([(None, a), (None, a), (None, b), (3, a), (None, b + "eleven"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in near_dedup.one_of_each(docs).collect()) in ([(0, ""), (0, b), (3, a)], [(0, ""), (0, b + "eleven"), (3, a)])
    texts = [r.text for r in suffix_dedup.strip_documents(docs).collect()]
    assert not any(a in (t or "") or b in (t or "") for t in texts)
    bench = spark.createDataFrame([(1, b)], "item_id long, text string")
    assert sorted(r.text or "" for r in decontaminate.clean_documents(docs, bench).collect()) == ["", a, a, a]
    assert token_files.round_trip(docs).count() == 6 and sharding.shard_by_bytes(docs).count() == 6 and packing.pack(docs).count() >= 6


def test_settings_stay_and_scratch_goes(spark, docs, tmp_path):
    """A query leaves the session's settings as they were, and in the shared folder no more than the table that it returns."""
    import os

    from minutary.llm import queries

    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "some words to look for in all of these texts here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(0, 300, 7)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i, k, "user", "hi") for i in range(5) for k in range(i)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    folder = common.shared_dir(spark).removeprefix("file://")
    for name, query in queries.queries().items():
        settings, before = dict(spark.conf.getAll), set(os.listdir(folder))
        query(spark, str(tmp_path)).collect()
        assert dict(spark.conf.getAll) == settings, name
        assert len(set(os.listdir(folder)) - before) <= 1, (name, set(os.listdir(folder)) - before)


def test_no_shared_folder_is_an_error():
    class Nothing:
        conf = sparkContext = property(lambda self: self)
        get = lambda self, *a: None
        getConf = lambda self: self

    with pytest.raises(ValueError):
        common.shared_dir(Nothing())


def test_null_ids_everywhere(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi " * 6, "one two three four five six seven eight nine ten " * 6
    table = spark.createDataFrame([(None, a), (None, b), (3, a), (None, None), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, b), (None, None)], "item_id long, text string")
    for out in (lm_score.score(table), token_counts.count_tokens(table), suffix_dedup.removals(table), decontaminate.scan(table, bench), quality.score_documents(table), near_dedup.near_classes(table)):
        assert sorted(r.doc_id or 0 for r in out.select("doc_id").collect()) == [0, 0, 0, 3, 4]


def test_very_long_texts(spark):
    """Texts of several MB, which are read in parts."""
    import random

    r = random.Random(2)
    make = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage, long = make(60), make(400_000)
    at = (1 << 20) - 300  # across the end of a part
    rows = [(1, long[:at] + passage + long[at:]), (2, make(50) + passage), (3, long[-3000:])]
    found = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[2] == (len(passage), 1) or found[2][0] >= len(passage)
    assert found[1][1] == 2 and found[3] == (3000, 1) and found[1][0] >= len(passage) + 3000
