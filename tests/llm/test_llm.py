"""The operators against brute force on small fixtures with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwarden.llm import ann, language_id, line_dedup, minhash, mixing, packing, quality_classifier, quality_rules, suffix_dedup, toxicity
from gridwarden.llm.components import components
from gridwarden.llm.queries import tokenizer_path

WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = [text(rng.randint(1, 120)) + "\n" + text(20) for _ in range(60)]
    near = []
    for b in base[:20]:
        w = b.split(" ")
        w[len(w) // 2] = "other"
        near.append(" ".join(w))
    texts = [*base, *near, *base[:5], None, "", "  ", "one two", "ONE two", text(3000), "a\n\nb\n a", "é " * 90, "x" * 400, "<|endoftext|> a  b"]
    return [(i, t, ["s1", "s2", None, "s3"][min(3, i % 7)], "clash", i) for i, t in enumerate(texts)] + [(0, base[0], "s1", "clash", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix string, id int").repartition(5).cache()


def words(t):
    return (t or "").encode().lower().split()


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs, bucket_rows=7).select("doc_id", "source", "mix.*").collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[2]] += len(words(r[1]))
    names = sorted((s for s in size if s is not None)) + [None]
    weight, cap = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {s: 2 * size[s] for s in names}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: float(cap[s]) for s in over}
        left -= sum(cap[s] for s in over)
        open_ -= over
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and abs(r["target"] - target[r["source"]]) < 1e-6
    assert all(0 <= target[s] - taken[s] < 2 for s in names)  # (0, base[0]) is there twice, and less than one word is lost by each
    assert sum(target[s] - taken[s] >= 1 for s in names) <= 1
    again = mixing.mix(docs.repartition(3), bucket_rows=7).select("doc_id", "mix.taken").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["taken"]) for r in got)
    clashing = docs.withColumns({c: F.lit(1) for c in ("target", "source_size", "size", "taken", "key", "rank", "rows", "bucket", "cut", "part", "epochs", "__cut", "__size", "__key", "__epoch", "__words")})
    other = mixing.mix(clashing, bucket_rows=7).collect()
    assert sorted((r["doc_id"], r["mix"]["taken"]) for r in other) == sorted((r["doc_id"], r["taken"]) for r in got) and {r["__key"] + r["target"] for r in other} == {2}
    mixed = mixing.apply_mix(mixing.mix(clashing, bucket_rows=7, out_col="m"), mix_col="m")
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), capacity=256, part_items=20).collect()
    want = Counter()
    for d, t, *_ in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 256 or min(len(ids), 256)
        for k, (s, e) in enumerate(zip([0, *range(first, len(ids), 256)], [*range(first, len(ids), 256), len(ids)])):
            want[d, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    least = packing.least_sequences(spark.createDataFrame([(r["length"],) for r in got], "length long"), 256)
    lengths = np.array([r["length"] for r in got])
    together = packing.best_fit_decreasing(lengths, 256)[2]  # all pieces in one partition
    assert least <= len(bins) <= min(least + 2, together + 1)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_rule_metrics():
    def brute(t):
        w = words(t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        return len({i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(5)})

    rng = random.Random(1)
    for _ in range(200):
        t = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        assert quality_rules.text_metrics(t)[4] == brute(t)
    assert quality_rules.text_metrics("a#b\n \na#b\n") == (2, 6, 2, 1, 0, 2)
    assert quality_rules.text_metrics(None) == quality_rules.text_metrics("") == (0,) * 6


def test_host_rules(spark, docs, rows):
    got = quality_rules.host_rules(docs).collect()
    assert len(got) == len(rows) and {"text", "mix", "rules"} <= set(got[0].asDict())
    for r in got:
        m = r["rules"]
        assert m["base_failed"] == (m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"])
        assert m["kept"] == (not m["base_failed"] and not m["host_failed"])
    bad = spark.createDataFrame([(i, "word " * 3, "spam") for i in range(400)] + [(1000 + i, " ".join(WORDS[i : i + 30]), "good") for i in range(200)] + [(2000, " ".join(WORDS[:30]), "spam"), (2001, "x", "tiny")], "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["rules"]["kept"] for r in quality_rules.host_rules(bad).collect()}
    assert kept[1005] and not kept[2000] and not kept[2001]
    assert quality_rules.host_rules(docs.limit(0)).count() == 0


def near_components(rows):
    sets = {}
    for d, t, *_ in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates(spark, docs, rows):
    want = near_components(rows)
    got = minhash.near_duplicates(docs.withColumn("key", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    alone = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")).collect()
    assert all(r["kept"] for r in alone)


def test_chains_of_near_duplicates(spark):
    """A chain of edits: neighbours are linked, ends are not; no pair may be lost for want of a common centre."""
    w = [f"t{i}" for i in range(400)]
    chain = []
    for i in range(40):
        chain.append((i, " ".join(w)))
        w[(10 * i) % 400] = f"e{i}"
    rows = [(d, t, None) for d, t in chain]
    want = near_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in want.items()}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)] + [(None, 3), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark):
    rng = random.Random(9)
    line = lambda: "".join(rng.choice("abcdefghij klmnop") for _ in range(80))
    a, b = line(), line()
    fuzzy = a[:40] + "#" + a[41:]
    rows = [(1, f"{a}\n{b}\n\nshort"), (2, f"{fuzzy}\nshort\n{line()}"), (3, b), (4, None), (5, ""), (6, "\n \n"), (3, b)]
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_gone"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    third = rows[1][1].split("\n")[2]
    assert got == [(1, rows[0][1], 4, 0), (2, third, 3, 2), (3, "", 1, 1), (3, "", 1, 1), (4, None, 0, 0), (5, "", 1, 0), (6, "\n \n", 3, 0)]
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_pairs_at_the_threshold(spark):
    rng = random.Random(21)
    lines = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=151)) for _ in range(2000)]
    fuzzy = [f"{x[:40]}#{x[41:100]}#{x[101:]}" for x in lines]
    assert line_dedup.similar(line_dedup.line_set(lines[0]), line_dedup.line_set(fuzzy[0]), 80)
    assert not line_dedup.similar(line_dedup.line_set(lines[0]), line_dedup.line_set(fuzzy[0]), 81)
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(fuzzy))], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_lines"], r["n_gone"]) for r in line_dedup.dedup_lines(df).collect()} == {1: (2000, 0), 2: (2000, 2000)}


def test_suffix_dedup(spark):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefé \n") for _ in range(n))
    shared = noise(260)
    rows = [(1, noise(300) + shared), (2, shared[:150] + noise(50) + shared[20:]), (3, "ab" * 200), (4, "ab" * 60), (5, shared), (6, None), (7, ""), (8, noise(99)), (9, shared[30:135]), (10, noise(50) + "c" * 250 + noise(20)), (11, rng.choice("xyz") * 130)]
    rows += [(20 + i, rows[i % 5][1]) for i in range(5)]
    seen, want = {}, {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if seen.setdefault(raw[k : k + 100], (d, k)) != (d, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        runs = sum(1 for x in range(len(gone)) if gone[x] and (x == 0 or not gone[x - 1]))
        want[d] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", F.lit(0))
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df).collect()} == want
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_suffix_dedup_of_null_and_repeated_ids(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdef \n") for _ in range(n))
    shared, head = noise(400), noise(220)
    rows = [(None, noise(2000) + shared[:300] + noise(90)), (None, shared[100:260]), (None, noise(60) + shared[150:]), (4, shared[50:350]), (4, noise(700) + shared[:250] + noise(300))]
    rows += [(None, noise(20) + head[:180]), (7, head + noise(40)), (7, head + noise(900)), (7, head + noise(41))]
    first = {}
    places = [(-(2**63) if d is None else d, t.encode()) for d, t in rows]
    for d, raw in places:
        for k in range(len(raw) - 99):
            first[raw[k : k + 100]] = min(first.get(raw[k : k + 100], (d, k)), (d, k))
    want = []
    for (d, _), (place, raw) in zip(rows, places, strict=True):
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if (place, k) > first[raw[k : k + 100]]:
                gone[k : k + 100] = b"\1" * 100
        want.append((str(d), len(raw), sum(gone), hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[:, 0] += rng.integers(0, 4, 900) * 3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, x[100].tolist()), (5100, None), (5200, [0.0] * 8), (5300, [float("nan")] * 8), (5400, [None, *[1.0] * 7]), (None, x[3].tolist()), (100, x[100].tolist())]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ids, vectors = np.r_[np.arange(900), 5000], np.concatenate([x, x[100:101]]).astype(float)
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    recall = []
    for q, found in got.items():
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        recall.append(len({ids[i] for i in order} & {v for v, _ in found.values()}) / 10)
        assert sorted(found) == list(range(1, 11)) and all(abs(s - d[ids == v][0]) < 1e-9 for v, s in found.values())
    assert np.mean(recall) >= 0.9 and got[100][1] == (5000, 0.0)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert ann.nearest(few, F.col("id") == 0).count() == 3
    assert ann.nearest(few.limit(0), F.col("id") == 0).count() == 0


def test_neighbours_beside_copies(spark):
    rng = np.random.default_rng(13)
    x = np.array([r[0] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("embedding").collect()], float)
    noisy = np.repeat(x, 2, axis=0)
    noisy += rng.normal(size=noisy.shape) * 0.5 * noisy.std()
    x = np.concatenate([x, noisy, np.repeat(x[7:8], 3000, axis=0)])  # a third of all are copies of one vector
    n = len(x) - 3000
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, (F.col("id") % 40 == 0) & (F.col("id") < n) | (F.col("id") == n + 2000)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    recall = {}
    for q, found in got.items():
        d = ann.distances(x, x[q])
        best = [i for i in np.lexsort((np.arange(len(x)), d)).tolist() if i != q][:10]
        recall[q] = len(set(best) & {v for _, v in found}) / 10
    assert recall.pop(n + 2000) == 1 and len(recall) == n // 40
    assert np.mean(list(recall.values())) >= 0.97


def test_language_id(spark):
    rng = random.Random(8)
    say = {"en": ["the", "and", "ing", "tion"], "de": ["der", "und", "ung", "sch"]}
    text = lambda lang, n=30: " ".join("".join(rng.choice(say[lang]) for _ in range(2)) for _ in range(n))
    model = language_id.fit(spark.createDataFrame([(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string"))
    pages = [(i, f"http://h{i % 4}.site{i % 2}.{'com' if i % 2 else 'de'}/x", f'<html lang="{"en" if i % 2 else "de"}"><script>var der</script><p>{text("en" if i % 2 else "de")}</p>') for i in range(40)]
    pages += [(100, "http://h1.site1.com/", ""), (101, "http://h0.site0.de/", None), (102, None, None)]
    got = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert all(got[i]["lang"] == ("en" if i % 2 else "de") for i in range(40))
    assert got[100]["lang"] == "en" and got[101]["lang"] == "de" and got[102]["lang"] in ("en", "de") and 0 <= got[102]["confidence"] <= 1
    assert language_id.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    m = quality_classifier.Machine(0.1, rng.normal(size=quality_classifier.WIDTH), rng.normal(size=(quality_classifier.WIDTH, 4)) * 0.1)
    f = quality_classifier.text_features("some words and some more", None)
    x = quality_classifier.strengths(f)
    z = m.bias + m.linear[f] @ x + sum(m.factors[f[i]] @ m.factors[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
    assert abs(m.score(f) - 1 / (1 + np.exp(-z))) < 1e-6


@pytest.mark.parametrize("module, label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").drop("source", "lang"), spark.read.parquet(f"{d}/labels.parquet")
    got = module.classify(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    assert np.mean([r[0] == r[1] for r in got]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "w " * 50_000), (3, None)], "doc_id long, text string")
    none = labels.limit(0)
    assert all(0 <= r["score"] <= 1 for r in module.classify(odd, none).collect()) and module.classify(odd.limit(0), labels.limit(0)).count() == 0


def test_automaton_equals_levenshtein():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    auto, rng = toxicity.Automaton(toxicity.LEXICON), random.Random(6)
    for _ in range(3000):
        w = list(rng.choice(toxicity.LEXICON))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "q", "e", "s"])
        w = "".join(w)
        near = [d for t in toxicity.LEXICON if (d := distance(t, w)) <= toxicity.allowed_errors(t)]
        hit = auto._run(w)
        assert (hit and hit[1]) == (min(near) if near else None), w


def test_quotation_weighs_less():
    auto = toxicity.automaton(toxicity.LEXICON)
    direct, quoted = toxicity.text_evidence("you are an idiot and a looser", auto), toxicity.text_evidence('they said "idiot" was the word', auto)
    assert direct[0] > quoted[0] and direct[1] > 0 and quoted[3] == 1 and toxicity.text_evidence(None, auto) == [0.0] * len(toxicity.FEATURES)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, seen = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append((docs.count(), docs.columns))
    assert all(c == columns for _, c in seen[:-1]) and all(n for n, _ in seen) and seen[2][0] <= seen[1][0] <= seen[0][0]


def test_suffix_dedup_of_hot_triggers_and_long_texts(spark):
    """More phrases of a trigger than one task takes, and a text longer than a part: as brute force."""
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    shared = noise(130)
    long = noise(suffix_dedup.PART - 150) + shared + noise(300)
    rows = [(i, noise(90) + shared + noise(90)) for i in range(40)] + [(50, long), (51, noise(40) + long[-500:])]
    seen, want = {}, {}
    for d, t in rows:
        raw, gone = t.encode(), bytearray(len(t))
        for k in range(len(raw) - 99):
            if seen.setdefault(raw[k : k + 100], (d, k)) != (d, k):
                gone[k : k + 100] = b"\1" * 100
        want[d] = (len(raw), sum(gone), hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"g": F.lit(1), "th": F.lit(2), "p": F.lit(3), "doc": F.lit(4), "marks": F.lit(5)})
    for hot in (suffix_dedup.HOT, 5):
        got = suffix_dedup.remove_repeats(df, hot=hot, with_text=True).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got} == want
        assert all(hashlib.sha256(r["kept_bytes"]).hexdigest() == r["kept_sha256"] for r in got)


def test_suffix_arrays_of_a_group():
    """Two rows are in one class at a depth just if they agree in so many bytes."""
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2, (60, 12)).astype(np.uint8)
    order, shared = suffix_dedup.sorted_suffixes(keys)
    assert [bytes(keys[i]) for i in order] == sorted(map(bytes, keys))
    for depth in range(13):
        c = suffix_dedup.classes(order, shared, depth)
        assert all((c[i] == c[j]) == (bytes(keys[i][:depth]) == bytes(keys[j][:depth])) for i in range(60) for j in range(60))


def test_exact_distances_are_few():
    """Footrule equals its definition, and fewer exact distances than vectors are measured for a query, with recall of 0.9."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    pivots = x[rng.choice(3000, 100, replace=False)]
    order = ann.orders(x, pivots, 50)
    files = ann.Files(np.arange(3000), x, order, 100)
    place = np.full((3000, 100), 50)
    np.put_along_axis(place, order.astype(np.int64), np.arange(50)[None].repeat(3000, 0), 1)
    whole = np.abs(place - place[7]).sum(1)
    assert len(set((whole - files.footrule(order[7])).tolist())) == 1
    hits = 0
    for q in range(0, 3000, 100):
        got = files.nearest(q, x[q], order[q], 10, 0.2)[0]
        d = ann.distances(x, x[q])
        hits += len(set(got.tolist()) & set([i for i in np.lexsort((np.arange(3000), d)).tolist() if i != q][:10]))
    assert files.measured <= 0.2 * 3000 * 30 + 30 and hits >= 0.9 * 300


CLASHING = "doc th id gone target source_size size taken key h1 h2 k x c component marks copy score label f n sig __doc __th __gone __new __cut __size __key __label __m __host __rate __its_host __its_id held_out predicted kept n_words piece sequence_id offset b q v o copies host domain suffix declared guess lang text_log".split()


@pytest.mark.parametrize("name", ["mix", "lines", "pack", "rules", "near", "quality", "toxic", "suffix"])
def test_columns_of_clashing_names(spark, name):
    """Extra columns bear names that operators use themselves: nothing crashes, and results are those without them."""
    plain = spark.createDataFrame([(i, f"some words of text number {i % 3} and ten more of them here\nsecond line {i}", ["a", None][i % 2]) for i in range(8)], "doc_id long, text string, source string")
    clash = plain.select("*", *[F.lit(7).alias(x) for x in CLASHING])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    run = {
        "mix": lambda d: mixing.mix(d).select("doc_id", "mix.taken"),
        "lines": lambda d: line_dedup.dedup_lines(d).select("doc_id", "text", "n_gone"),
        "pack": lambda d: packing.pack(d, tokenizer_path()).select("doc_id", "length", "ids_crc32"),
        "rules": lambda d: quality_rules.host_rules(d).select("doc_id", "rules.n_words", "rules.kept"),
        "near": lambda d: minhash.near_duplicates(d),
        "quality": lambda d: quality_classifier.classify(d, labels).select("doc_id", "score", "predicted"),
        "toxic": lambda d: toxicity.classify(d, labels).select("doc_id", "score", "predicted"),
        "suffix": lambda d: suffix_dedup.remove_repeats(d),
    }[name]
    assert sorted(map(tuple, run(clash).collect())) == sorted(map(tuple, run(plain).collect()))


def test_vectors_and_pages_of_clashing_names(spark):
    extra = [F.lit(7).alias(x) for x in CLASHING]
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    both = [sorted(map(tuple, ann.nearest(d, F.col("id") % 10 == 0).collect())) for d in (vectors, vectors.select("*", *extra))]
    assert both[0] == both[1] and len(both[0]) == 30
    texts = spark.createDataFrame([(i, ["the thing and this", "der und die das"][i % 2] * 5, ["en", "de"][i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    model = language_id.fit(texts)
    pages = spark.createDataFrame([(1, "http://a.de/", "<p>der und das</p>"), (1, "http://a.de/", "<p>der und das</p>"), (2, "x", "the thing " * 40_000), (3, "", "")], "page_id long, url string, html string")
    both = [sorted(map(tuple, language_id.identify(d, model).collect())) for d in (pages, pages.select("*", *extra))]
    assert both[0] == both[1] and [r[1] for r in both[0]][:3] == ["de", "de", "en"]


def test_line_dedup_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    first, count = {}, Counter()
    for d, t in texts:
        for j, line in enumerate(t.split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                first.setdefault(line, (d, j))
                count[line] += 1
    lines = list(first)
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} if len(x) >= 8 else {x.ljust(8, "\0")} for x in lines]
    holders, root = {}, list(range(len(lines)))
    for i, s in enumerate(sets):
        for v in s:
            holders.setdefault(v, []).append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for v in s for j in holders[v] if j < i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    head = {}
    for i, line in enumerate(lines):
        head[find(i)] = min(head.get(find(i), first[line]), first[line])
    place = {line: head[find(i)] for i, line in enumerate(lines)}
    want = {d: "\n".join(x for j, x in enumerate(t.split("\n")) if x not in place or place[x] == (d, j)) for d, t in texts}
    got = {r["doc_id"]: r["text"] or "" for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want and any(len(want[d]) < len(t) for d, t in texts)


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    own, quick, rng = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path()), random.Random(31)
    pool = ["a", "the", "é", "ß", "中文", "1234", "!?", " ", "  ", "\n", "\t", "'s", "don't", " ", "😀", "x" * 40, "<|endoftext|>", "ß "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    assert [x.tolist() for x in quick.encode_batch(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]
