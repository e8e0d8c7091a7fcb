"""Each operator against a plain loop, on texts with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import html
import random
import re
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import cases  # noqa: E402

from rollbook.llm import classifier, html_text, queries, sentence_pieces, suffixes, texts  # noqa: E402
from rollbook.llm.line_dedup import line_dedup  # noqa: E402
from rollbook.llm.near_dup import near_duplicates  # noqa: E402
from rollbook.llm.packing import Encoder, packed, plan  # noqa: E402
from rollbook.llm.quality_rules import quality_rules  # noqa: E402
from rollbook.llm.secrets import redacted, secret_report  # noqa: E402
from rollbook.llm.suffixes import substring_dedup, suffix_array  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def shingles(text: str, n: int) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def near_by_loop(docs, n):
    sets = {i: shingles(t, n) for i, t in docs}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def substrings_by_loop(docs, size=50):
    first, out = {}, {}
    for i, t in sorted(docs):
        b = t.encode()
        for p in range(len(b) - size + 1):
            first.setdefault(b[p : p + size], i)
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def small(rows):
    return [(r[0], r[1] or "") for r in rows if r[0] is not None]


@pytest.mark.parametrize("given", [False, True])
def test_near_duplicates(spark, given):
    df = spark.read.parquet(f"{SF}/documents.parquet") if given else cases.table(spark)
    docs = documents(spark) if given else small(cases.rows())
    want = near_by_loop(docs, 4)
    got = near_duplicates(df, words=4).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def family(seed=11, members=60):
    """Documents that share most words: some pairs are linked, others just miss the similarity."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 999)}" for _ in range(300)]
    out = []
    for i in range(members):
        words = list(base)
        for p in rng.sample(range(300), rng.choice([2, 6, 9, 12])):
            words[p] = f"x{rng.randint(0, 9999)}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize(("stars", "block"), [(0, 2048), (0, 7), (2, 7)])
def test_near_duplicates_of_large_buckets(spark, stars, block):
    """The same with any number of stars, and with buckets met block by block."""
    docs = family()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_duplicates(df, words=4, stars=stars, block=block).collect()
    want = near_by_loop(docs, 4)
    assert len({c for _, c in want.values()}) > 3
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_of_one_id(spark):
    """Rows of one id with different texts are documents each."""
    docs = family(5, 4)
    rows = [(1, "alone in this row " * 9), (1, docs[0][1]), (2, docs[0][1]), (3, "alone in this row " * 9), (4, "something else")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [
        (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring_dedup(spark, hot):
    for df, docs in ((spark.read.parquet(f"{SF}/documents.parquet"), documents(spark)),
                     (cases.table(spark), small(cases.rows()))):
        want = substrings_by_loop(docs)
        got = substring_dedup(df, hot=hot).collect()
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is not None:
                assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_substring_dedup_without_broadcasts(spark, monkeypatch):
    """On large inputs no list of keys is broadcast; parts are then shuffled once, to their group."""
    monkeypatch.setattr(suffixes, "BROADCAST_IDS", -1)
    parts, by_key = [], suffixes._by_key

    def seen(df, keys):
        parts.append(by_key(df, keys))
        return parts[-1]

    monkeypatch.setattr(suffixes, "_by_key", seen)
    want = substrings_by_loop(small(cases.rows()))
    for r in substring_dedup(cases.table(spark), hot=8).collect():
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    places = parts[0].select("key", F.spark_partition_id().alias("at")).distinct()
    assert places.groupBy("key").count().where("count > 1").isEmpty()


def test_whole_copies_make_no_segments(spark, monkeypatch):
    """A copied text has its anchors in two documents, but nothing of it is cut and stored for that."""
    rnd = random.Random(5)
    one, other = ("".join(rnd.choice("abcdefgh ") for _ in range(900)) for _ in range(2))
    kept, stored = suffixes._stored, {}

    def seen(df, name):
        stored[name] = kept(df, name)
        return stored[name]

    monkeypatch.setattr(suffixes, "_stored", seen)
    docs = [(3, one), (4, other), (7, one), (7, one), (9, one)]
    got = substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(3, 0), (4, 0), (7, 900), (7, 900), (9, 900)]
    assert stored["repeat-segments"].isEmpty()


def stored_steps(monkeypatch):
    """What a run stores, by name."""
    kept, stored = suffixes._stored, {}

    def seen(df, name):
        stored[name] = kept(df, name)
        return stored[name]

    monkeypatch.setattr(suffixes, "_stored", seen)
    return stored


def test_common_phrases_make_no_segments(spark, monkeypatch):
    """Texts that share many strings of 20 bytes, but none of 33, leave nothing to compare."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    phrases = [word(20) for _ in range(5)]
    docs = [(i, " ".join(word(9) + rnd.choice(phrases) for _ in range(60))) for i in range(12)]
    stored = stored_steps(monkeypatch)
    got = substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(i, 0) for i in range(12)]
    assert stored["repeat-segments"].isEmpty()


@pytest.mark.parametrize("hot", [4096, 1])
def test_periodic_texts_make_few_parts(spark, monkeypatch, hot):
    """Equal parts of one content are one row, and their runs are joined."""
    docs = [(1, "ab" * 400), (2, "x" + "ab" * 500 + "y"), (3, "ab" * 300 + "z"), (4, "zzz" + "-" * 900), (5, "-" * 700)]
    parts, few = [], suffixes._by_key

    def seen(df, keys):
        parts.append(df)
        return few(df, keys)

    monkeypatch.setattr(suffixes, "_by_key", seen)
    stored = stored_steps(monkeypatch)
    want = substrings_by_loop(docs)
    for r in substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert (stored["repeat-large"] if hot == 1 else parts[0]).count() < 900
    assert 0 < stored["repeat-runs"].count() < 900


def test_windows_of_large_groups_are_not_broadcast(spark):
    """Spark takes the exploded windows for as small as the parts; equal parts are compared once."""
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh") for _ in range(60))
    rows = [(1, i, i, text.encode(), [0, 3] if i == 5 else [i]) for i in range(2, 9)] + [(1, 9, 1, text[:55].encode(), [7]), (1, 10, 1, b"-" * 50, [0])]
    df = spark.createDataFrame(rows, "anchor long, hash long, first long, part binary, shifts array<int>")
    runs = suffixes._dealt(df)
    assert sorted(runs.collect()) == [(1, 2, 2, 2, 6)] + [(1, i, i, i if i != 5 else 0, 11 if i != 5 else 14) for i in range(3, 9)]
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_groups_of_unequal_strings():
    """Parts whose keys have one hash but are other strings share nothing."""
    rows = [(7, 1, i, i, 17, b"l" * 17 + key * 33 + b"r" * 17, [0]) for i, key in ((1, b"a"), (2, b"b"), (3, b"a"))]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                       ["key", "anchor", "hash", "first", "inner", "part", "shifts"])
    out = pa.Table.from_batches(suffixes._grouped(iter([batch]))).to_pylist()
    assert [tuple(r.values()) for r in out] == [(1, 3, 3, 0, 18)]


def test_trimmed_parts():
    """No shared window is lost with the outer bytes, and parts without one are not looked at."""
    rnd = random.Random(3)
    for _ in range(200):
        side = lambda: bytes(rnd.choice(b"ab") for _ in range(rnd.choice((9, 17, 17))))
        parts = list({(len(left), left + b"k" * 33 + side()): 0 for left in (side() for _ in range(6))})
        firsts = [rnd.randint(1, 3) for _ in parts]
        windows = [{(at, part[at : at + 50]) for at in range(len(part) - 49)} for _, part in parts]
        aligned = [{(at - inner, w): at for at, w in own} for (inner, _), own in zip(parts, windows)]
        want = {(k, at) for k, own in enumerate(aligned) for x, at in own.items()
                if any(x in other and firsts[j] < firsts[k] for j, other in enumerate(aligned))}
        some = suffixes._trimmed(parts)
        runs = suffixes.shared_windows([x[2] for x in some], [firsts[x[0]] for x in some])
        assert {(some[k][0], some[k][1] + at + i) for k, at, n in runs for i in range(n)} == want
    assert not suffixes._trimmed([(17, b"a" * 17 + b"k" * 33 + b"b" * 17), (17, b"c" * 17 + b"k" * 33 + b"d" * 17)])


def test_stored_steps_leave_no_shuffles(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {name for name in names if name.startswith("shuffle_")}

    def left():
        for _ in range(50):  # executors remove their files in the background
            if not shuffles() - before:
                break
            time.sleep(0.2)
        return shuffles() - before

    before = shuffles()
    was = spark.conf.get(suffixes.DROP_SHUFFLES, "false")
    rows = suffixes._stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-dropped")
    assert sorted(r["count"] for r in rows.collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert not left()
    assert spark.conf.get(suffixes.DROP_SHUFFLES, "false") == was


def test_suffix_array():
    rng = np.random.default_rng(5)
    for _ in range(500):
        x = [*rng.integers(1, rng.integers(2, 5), rng.integers(0, 40)).tolist(), 0]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def lines_by_loop(docs):
    where = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        x = t.split("\n")
        for k in range(len(x) - 2):
            if WORD.search("\n".join(x[k : k + 3])):
                where.setdefault(tuple(x[k : k + 3]), (i, k))
    out = {}
    for i, t in docs:
        x = t.split("\n")
        gone = set()
        for k in range(len(x) - 2):
            if where.get(tuple(x[k : k + 3]), (i, k)) < (i, k):
                gone |= {k, k + 1, k + 2}
        out[i] = (len(x), len(gone), "\n".join(v for k, v in enumerate(x) if k not in gone))
    return out


def test_line_dedup(spark):
    for df, docs in ((spark.read.parquet(f"{SF}/documents.parquet"), documents(spark)),
                     (cases.table(spark), small(cases.rows()))):
        want = lines_by_loop(docs)
        got = line_dedup(df).collect()
        assert len(got) == df.count()
        for r in got:
            if r.text is None:
                assert (r.n_lines, r.n_removed) == (0, 0)
            elif r.doc_id is not None:
                assert (r.n_lines, r.n_removed, r.text) == want[r.doc_id]


BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
     lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def test_secret_scan(spark):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), cases.table(spark)):
        text_of = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}
        got = secret_report(df).collect()
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is None:
                continue
            found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE)
                           for m in p.finditer(text_of[r.doc_id]) if ok(m))
            listed = [f"{BASE[k][0]}:{a}:{b}" for a, k, b in found]
            assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(Counter(k for _, k, _ in found)[k] for k in range(3))
            assert set(listed) <= set(r.spans.split(",")) | {""}


def test_weak_secrets_need_a_partner(spark):
    spans = {r.doc_id: r.spans for r in secret_report(cases.table(spark)).collect()}
    assert "user:" in spans[15] and "endpoint:" in spans[15]
    assert spans[17] == ""
    masked = {r.doc_id: r.text for r in redacted(cases.table(spark)).collect()}
    assert "hunter22abc" not in masked[15] and "AKIA" not in masked[15]
    assert masked[17] == "user=alice went to https://example.com" and masked[8] is None


def brute_links(text: str, scope: int = 200) -> list[str]:
    """All spans by comparing every weak span with every other."""
    from rollbook.llm import secrets

    def found(kind, pattern, passes=lambda m: True):
        return [(m.start(), secrets.KINDS.index(kind), m.end()) for m in re.finditer(pattern, text) if passes(m)]

    base = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m))
    mixed = lambda m: all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))
    weak = found("user", secrets.USER) + found("opaque", secrets.OPAQUE, mixed) + found("endpoint", secrets.ENDPOINT)
    weak = [w for w in weak if not any(w[0] < b[2] and b[0] < w[2] for b in base)]
    secret = [secrets.KINDS.index(k) for k in secrets.SECRET_KINDS]
    linked = [w for w in weak if any(
        (w[1] in secret) != (o[1] in secret) and o[0] < w[2] + scope and o[2] > w[0] - scope for o in base + weak)]
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + linked)]


def credentials(seed: int, n: int) -> str:
    rng = random.Random(seed)
    some = ["password=abcDEF%09dxyz", "user=bob%d", "https://h%d.example.com/x", "AKIA%016d", "%032x", "wörd %d",
            "Ab%020dZ", "token: %d", "aaBB11%030d", "login = %d user: amy secret=\"%d9999999"]
    return " ".join((x % ((rng.randrange(10**8),) * x.count("%"))) + " filler" * rng.randrange(60) for x in rng.choices(some, k=n))


def test_secret_links_by_brute_force(spark):
    """Every span and mask of texts with more matches than one stretch holds."""
    texts = {i: credentials(i, n) for i, n in enumerate((3, 40, 200, 1500))}
    df = spark.createDataFrame([*texts.items(), (9, None), (9, "")], "doc_id long, text string")
    for r in secret_report(df).where("doc_id < 9").collect():
        assert r.spans == ",".join(brute_links(texts[r.doc_id]))
    masked = {r.doc_id: r.text for r in redacted(df).where("doc_id < 9").collect()}
    for i, text in texts.items():
        out, at = [], 0
        for _, a, b in (s.split(":") for s in brute_links(text)):
            if int(a) >= at:
                out += [text[at : int(a)], "[SECRET]"]
            at = max(at, int(b))
        assert masked[i] == "".join([*out, text[at:]])


def test_secrets_of_one_long_text(spark):
    """A text of a megabyte made of matches is scanned and masked in time about in proportion."""
    runs = [f"{i:028x}" for i in range(32000)]
    df = spark.createDataFrame([(1, " ".join(runs))], "doc_id long, text string")
    assert secret_report(df).first().n_hex == 32000
    assert redacted(df).first().text == " ".join(["[SECRET]"] * 32000)


def test_quality_counts(spark):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), cases.table(spark)):
        text_of = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}
        got = quality_rules(df).collect()
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is None:
                continue
            t = text_of[r.doc_id]
            w = WORD.findall(t)
            runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
            often = Counter(runs)
            covered = {i + k for i, x in enumerate(runs) if often[x] > 1 for k in range(3)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
            assert not (r.kept and r.base_failed)


def test_quality_fences_follow_the_cell(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k * 3) % 997}" for k in range(80)), "en", "a") for i in range(400)]
    rows += [(1000 + i, " ".join(f"x{(i + k * 5) % 991}###" for k in range(80)), "en", "a") for i in range(8)]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(400)) and not any(got[1000 + i] for i in range(8))


def test_classifier_on_held_out(spark):
    got = queries.op6_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id])
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_classifier_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = classifier.fit(cases.table(spark), none)
    assert {r.score for r in classifier.scored(cases.table(spark), model).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(1, 18)] + [(3, None), (None, 0)], "doc_id long, quality int")
    got = classifier.scored(cases.table(spark), classifier.fit(cases.table(spark), one)).collect()
    assert len(got) == len(cases.rows()) and all(0 <= r.score <= 1 for r in got)


def test_classifier_sample_is_bounded(spark):
    """Very long texts and repeated ids reach the driver as a bounded bag each."""
    pooled = classifier.pooled
    x = np.arange(1300, dtype=np.float32).reshape(-1, 1)
    assert len(pooled(x, 512)) == 512 and abs(pooled(x, 512).mean() - x.mean()) < 1 and pooled(x, 1300) is x
    docs = spark.createDataFrame([(i % 20, f"word{i} " * (40000 if i == 3 else 80)) for i in range(60)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = classifier.fit(docs, labels, sample=10, bag=4)
    assert all(np.isfinite(v).all() for v in model.values())
    assert not classifier.fit(docs.where("false"), labels)["c"].any()


def test_encoder_equals_tokenizer():
    encoder = Encoder(queries.tokenizer_path("word_bpe_49k.json"))
    own = [r[1] or "" for r in cases.rows()]
    for i, j, data, offsets in texts.slices(pa.array(own)):
        ids, first = encoder.encode(data, offsets)
        for k in range(j - i):
            assert ids[first[k] : first[k + 1]].tolist() == encoder.tokenizer.encode(own[i + k], add_special_tokens=False).ids


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    got = packed(cases.table(spark), path, capacity=512).collect()
    check_packing(got, 512)
    text_of = {r[0]: r[1] or "" for r in cases.rows()}
    tokenizer = Encoder(path).tokenizer
    for r in got:
        ids = np.array([*tokenizer.encode(text_of[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert r.start == r.piece * 512 and zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32
    assert sum(r.doc_id == 9 for r in got) == 1
    whole = queries.op10_best_fit_packing(spark, SF).collect()
    bound = -(-sum(r.length for r in whole) // 4096)
    assert check_packing(whole, 4096) <= 1.02 * bound + 1


def test_plan_places_every_rank():
    rng = np.random.default_rng(9)
    for _ in range(20):
        histogram = {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, 101, 30)}
        seen = Counter()
        ends = {}
        for length, low, high, first, each, offset in plan(histogram, 100):
            for r in range(low, high):
                seen[length, r] += 1
                ends.setdefault(first + (r - low) // each, []).append((offset + (r - low) % each * length, length))
        assert seen == Counter({(k, r): 1 for k, n in histogram.items() for r in range(n)})
        for parts in ends.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 100


PAGE = """<html><head><title>T</title><script>if (a < b) "</p>";</script></head><body class="home">
<div id="cookie-notice">We use cookies</div><nav><ul><li><a href="/">Home</a></li></ul></nav>
<article><header><h1>Title &amp; more</h1></header><p>First <b>part</b>
 of it.<p>Second &lt;one&gt;</p><div class="ad">Buy now</div><aside>Other</aside>
<section class="comments"><p>I like it very much and write so at length.</p></section></article>
<form><label>Mail</label><input></form><footer>&copy; x</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "Title & more\nFirst part of it.\nSecond <one>"
    long = "plain words of a paragraph that goes on for quite a while and has no links in it at all "
    page = f"<body><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><p>{long}</p><p>Yes.</p><p>{long}</p></body>"
    assert html_text.main_text(page) == f"{long.strip()}\nYes.\n{long.strip()}"
    assert html_text.main_text("") == "" and html_text.main_text("<p") == ""


def test_html_loses_no_article_text(spark):
    long = " ".join(["word"] * 30)
    links = "<ul><li><a href=x>See also</a></li><li><a>More</a></li></ul>"
    whole = {
        "before a footer of links": f"<article><h1>T</h1><p>{long} 1</p>{links}<p>{long} 2</p></article><footer><a>Home</a></footer>",
        "no article marked": f"<div>{links}<h1>T of it all</h1><p>{long} 1</p><p>{long} 2</p>{links}</div>",
        "open drawing": f"<article><p>{long} 1</p><svg><path d='x'/><p>{long} 2</p></article>",
        "closed at once": f"<article><p>{long} 1</p><svg/><p>{long} 2</p></article>",
        "open button": f"<article><p>{long} 1</p><button>Go<p>{long} 2</p><button>Close</button></article>",
        "open player": f"<article><p>{long} 1</p><video><p>{long} 2</p></article>",
        "closed player": f"<article><p>{long} 1</p><video><p>no video</p></video><p>{long} 2</p></article>",
        "head without its end": f"<html><head><title>t</title><body><article><p>{long} 1</p><p>{long} 2</p></article>",
        "link without its end": f"<article><p>{long} 1</p><p><a href=x>see</p><p>{long} 2</p></article>",
    }
    for name, page in whole.items():
        lines = html_text.main_text(page).split("\n")
        assert f"{long} 1" in lines and f"{long} 2" in lines, name
        assert not {"See also", "More", "Home", "Go", "Close", "no video", "t"} & set(lines), name
    df = spark.createDataFrame([(1, None, "old"), (2, whole["open button"], "old"), (2, whole["open button"], "old")],
                               "page_id long, html string, text string")
    got = [r.text for r in html_text.extracted(df).orderBy("page_id").collect()]
    assert got == ["", f"{long} 1\n{long} 2", f"{long} 1\n{long} 2"]
    assert html_text.extracted(df.where("false")).collect() == []


def test_links_across_blocks():
    assert [b[2] for b in html_text.blocks("<a href=x><div>Read this</div></a><div>Not <a>that</a></div>")] == [1.0, 0.5]


def test_html_given_pages(spark):
    got = {r.page_id: r.text for r in queries.op2_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = r.html.split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", body))
        assert got[r.page_id] == "\n".join(x for x in parts if x)


def viterbi(pieces, text):
    best = [(0.0, ())] + [(-1e300, ())] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - 20), end):
            if text[begin:end] in pieces.plain:
                s = best[begin][0] + pieces.plain[text[begin:end]][0]
                if s > best[end][0]:
                    best[end] = (s, (*best[begin][1], pieces.plain[text[begin:end]][1]))
        if text[end - 1] not in pieces.plain:
            s = best[end - 1][0] + pieces.unknown
            if s > best[end][0]:
                best[end] = (s, (*best[end - 1][1], *(pieces.bytes_id[b] for b in text[end - 1].encode())))
    return list(best[-1][1])


def test_sentence_pieces(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    pieces = sentence_pieces.pieces(path)
    own = [r[1] or "" for r in cases.rows()] + [" a  b\n c ", "\n\n", "é中𝒳\x00z", "  "]
    for text, ids in zip(own, pieces.encode(own)):
        assert pieces.decode(ids) == text
        if len(text) < 2000:
            assert ids == (viterbi(pieces, "▁" + text.replace(" ", "▁")) if text else [])
    got = sentence_pieces.decoded(sentence_pieces.encoded(cases.table(spark), path), path).collect()
    assert all(r.decoded == (r.text or "") for r in got)
    assert all(r.round_trip for r in queries.op3_sentence_pieces(spark, SF).collect())


def test_sentence_pieces_forget_and_replace(spark, monkeypatch):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    texts_ = [t for _, t in documents(spark)]
    want = sentence_pieces.Pieces(path).encode(texts_)
    monkeypatch.setattr(sentence_pieces, "CACHED", 500)
    small = sentence_pieces.Pieces(path)
    assert [ids for i in range(0, len(texts_), 7) for ids in small.encode(texts_[i : i + 7])] == want
    assert len(small.known) <= 500
    raw = [[small.bytes_id[0xE6]], [], [small.bytes_id[32], small.bytes_id[0xE6]], [1, 2], small.encode(["a é"])[0]]
    column = sentence_pieces.pa.array([*raw, None], sentence_pieces.pa.list_(sentence_pieces.pa.int32()))
    got = [t for run in sentence_pieces._some_lists(column, 2) for t in small.decode_run(*run).to_pylist()]
    assert got == ["\ufffd", "", "\ufffd", "", "a é", ""]
    df = spark.createDataFrame([("x y", "old", 3), (None, "old", 4)], "text string, decoded string, ids int")
    rows = sentence_pieces.decoded(sentence_pieces.encoded(df, path), path).select("text", "decoded").collect()
    assert [tuple(r) for r in rows] == [("x y", "x y"), (None, "")]
    assert sentence_pieces.decoded(sentence_pieces.encoded(cases.empty(spark), path), path).count() == 0


def test_empty_tables(spark):
    df = cases.empty(spark)
    for got in (near_duplicates(df), substring_dedup(df), line_dedup(df), secret_report(df), redacted(df),
                quality_rules(df), packed(df, queries.tokenizer_path("word_bpe_49k.json"))):
        assert got.count() == 0
