"""Every operator against brute force, round trips or held-out rows, on rows that are hard to get right."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import common, exact_dedup, packing, pii, secret_scan, sentence_pieces, simhash, topk_search, toxicity, url_filter, warc

from .cases import documents, frame, prose


def collected(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# exact deduplication


def brute_exact(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, n))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for _, none, i, _ in members:
            out.append((None if none else i, None if best[1] else best[2], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out), len(groups)


def test_exact_duplicates_match_brute_force(spark):
    got = exact_dedup.exact_duplicates(frame(spark), fan=1)
    want, groups = brute_exact(documents())
    rows = collected(got, "doc_id", "keep_id", "group_size", "text_sha256")
    assert Counter(rows) == want
    assert sum(collected(got, "kept")[i][0] for i in range(len(rows))) == groups


def test_deduplicated_keeps_one_row_a_group_and_all_columns(spark):
    df = frame(spark)
    out = exact_dedup.deduplicated(df)
    assert out.columns == df.columns
    assert out.count() == brute_exact(documents())[1]


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def test_index_levels_compact_to_the_least_id(spark):
    index = exact_dedup.DigestIndex(spark)
    index.flush(batch(spark, (5, "a b"), (6, "c")))
    index.flush(batch(spark, (3, "ab "), (9, "ab")))
    assert {(~r["best"]["not_id"], r["size"]) for r in index.compact().collect()} == {(3, 3), (6, 1)}
    hits = index.lookup(spark.createDataFrame([(70, "AB", 1, 2), (71, "a\tb", 1, 2)], "doc_id long, text string, digest int, known_id int"))
    assert collected(hits, "doc_id", "digest", "known_id") == [(71, 1, 3)]


def test_full_levels_are_merged_into_sorted_runs(spark):
    index = exact_dedup.DigestIndex(spark, fan=2)
    for n in range(4):
        index.flush(batch(spark, (10 - n, "same"), *((100 * n + i, f"t{100 * n + i}") for i in range(50))))
    assert [len(level) for level in index.levels] == [0, 0, 1]
    (run,) = index.levels[2]
    entries = spark.read.parquet(run.path).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    assert len(entries) == 201 and max((e["size"], ~e["best"]["not_id"]) for e in entries) == (4, 7)
    by_file = defaultdict(list)
    for e in entries:
        by_file[e["file"]].append(bytes(e["digest"]))
    assert all(d == sorted(d) for d in by_file.values())
    spans = sorted((d[0], d[-1]) for d in by_file.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_a_lookup_skips_runs_whose_filter_holds_none_of_its_digests(spark):
    index = exact_dedup.DigestIndex(spark)
    index.flush(batch(spark, *((i, f"old {i}") for i in range(300))))
    index.flush(batch(spark, *((1000 + i, f"new {i}") for i in range(300))))
    hits = index.lookup(batch(spark, (1, "new7"), (2, "nowhere")))
    assert collected(hits, "doc_id", "known_id") == [(1, 1007)]
    assert index.read == [index.levels[0][1].path]
    assert index.lookup(batch(spark)).count() == 0


def test_a_filter_passes_all_members_and_few_others(spark):
    members = common.materialise(spark.range(0, 30_000, 3).select(F.xxhash64("id").alias("h")), "members")
    held = common.BitFilter(members)
    passed = {r["id"] for r in held.passed(spark.range(30_000), F.xxhash64("id")).collect()}
    assert set(range(0, 30_000, 3)) <= passed and len(passed) < 13_000
    rows = spark.createDataFrame([(i, "x", 1) for i in (5, 6, 6, 7)], "k long, word string, bits int")
    gone = common.materialise(spark.createDataFrame([(6,), (8,)], "k long"), "members")
    assert sorted(collected(common.without(rows, "k", gone), "k", "word", "bits")) == [(5, "x", 1), (7, "x", 1)]


# SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=2):
    top = list(range(len(fps)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                top[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        r = root(i)
        if x is not None:
            least[r] = min(least.get(r, x), x)
    return [least.get(root(i)) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [1, 8])
def test_simhash_matches_brute_force(spark, bucket):
    """Bucket 1 sends every shared key through the dense path."""
    rows = documents()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = Counter(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], brute_components([i for i, _ in rows], fps), strict=True))
    got = simhash.near_duplicates(frame(spark), bucket=bucket)
    assert Counter(collected(got, "doc_id", "fingerprint", "component_id")) == want


@pytest.mark.parametrize("bucket", [1, 4])
def test_links_lose_nothing_on_dense_and_sparse_fingerprints(spark, bucket):
    rng = np.random.default_rng(3)
    seeds = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = set(seeds)
    for s in seeds[:6]:
        for _ in range(60):
            x = s
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in collected(simhash.links(df, bucket=bucket), "a", "b")]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in edges)
    from scriptorium.llm.components import components

    found = dict(collected(components(spark.createDataFrame([(simhash._signed(a), simhash._signed(b)) for a, b in edges], "a long, b long")), "node", "root"))
    want = brute_components(list(range(len(fps))), fps)
    groups = defaultdict(set)
    for n, f in enumerate(fps):
        groups[found.get(simhash._signed(f), simhash._signed(f))].add(n)
    assert {min(g): g for g in groups.values()} == {w: {i for i, x in enumerate(want) if x == w} for w in set(want)}


def test_masks_cover_every_pair_of_positions():
    masks = simhash.masks(2)
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(i))


# toxicity


def test_toxicity_separates_and_never_learns_from_the_fold(spark):
    clean = [(i, prose(i, 60)) for i in range(300)]
    toxic = [(1000 + i, prose(5000 + i, 40) + " you idiot " + prose(9000 + i, 10) + " pathetic idiot") for i in range(60)]
    rows = clean + toxic + [(5000, None), (5001, ""), (None, "x"), (5002, "y " * 40_000)]
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic] + [(7, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(frame(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i if i is not None else "").encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i, _ in clean + toxic if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i >= 1000) for i in held) >= 0.97 * len(held)


def test_toxicity_without_labels_scores_zero(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.scored(frame(spark), none).collect()} == {0}
    assert toxicity.scored(frame(spark, []), none).count() == 0


def test_the_bound_keeps_clean_rows_whatever_the_rate_of_toxic_ones():
    """Toxic words stand in some clean texts too, so the rows set aside have to place the bound."""
    import pandas as pd

    def rows(count, every, seed):
        r = random.Random(seed)
        out = []
        for i in range(count):
            toxic = i % every == 0
            words = prose(seed + i, 50).split()
            for _ in range(4 if toxic else r.random() < 0.05):
                words[r.randrange(len(words))] = r.choice(["idiot", "scum", "moron", "trash"])
            out.append((i, " ".join(words), int(toxic), zlib.crc32(b"%d" % i)))
        return pd.DataFrame(out, columns=["doc_id", "text", "toxic", "turn"])

    for every in (2, 12):
        model = next(toxicity.fit_frames([rows(2400, every, 0)], 3))
        score = model.scorer()
        test = rows(1200, every, 50_000)
        flagged = np.array([score(t) >= 0.5 for t in test["text"]])
        labels = test["toxic"].to_numpy() == 1
        assert flagged[~labels].mean() < 0.03 and flagged[labels].mean() > 0.97


def test_the_sample_of_a_large_table_keeps_its_rate_and_its_bounds(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    seen, fit = [], toxicity.common.materialise
    toxicity.common.materialise = lambda df, label, *a: (seen.append(fit(df, label, *a)), seen[-1])[1]
    try:
        toxicity.train(docs, labels, rows=5000, epochs=1)
    finally:
        toxicity.common.materialise = fit
    n, toxic = seen[0].agg(F.count(F.lit(1)), F.sum("toxic")).first()
    assert 4500 < n < 5500 and 0.08 < toxic / n < 0.12


def test_ftrl_weights_are_sparse():
    texts = [prose(i, 50) + (" scum" if i % 4 == 0 else "") for i in range(400)]
    model = toxicity.fit(texts, [int(i % 4 == 0) for i in range(400)])
    assert 0 < len(model.index) < 200


# secrets


def brute_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?a:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_spans_match_brute_force_and_the_model_adds(spark):
    got = secret_scan.scanned(frame(spark)).collect()
    assert len(got) == len(documents())
    markov = 0
    for r in got:
        spans = [(s["start"], s["kind"], s["end"]) for s in r["secret_spans"]]
        assert [s for s in spans if s[1] < 3] == brute_spans(r["text"])
        assert spans == sorted(spans)
        markov += sum(s[1] == 3 for s in spans)
        if r["doc_id"] is not None and r["doc_id"] < 300:
            assert not spans
    assert markov >= 1


def test_the_rest_of_a_token_beside_a_pattern_is_scored(spark):
    rest = "zQ7xK2pLm9vRt4sWyB8nHc3dTj6fGk1uXoEa5iVq"
    rows = [(i, prose(i, 200)) for i in range(50)]
    rows += [(900, f"id 1234567890123456789-{rest} end"), (901, f"id {rest}-1234567890123456789-{rest[::-1]}")]
    # Samples without the test's own keys, of which a table this small would make ordinary words.
    samples = secret_scan.random_samples(spark, 2000).union(secret_scan.ordinary_samples(frame(spark, rows[:50])))
    scanned = secret_scan.scanned(frame(spark, rows), samples).where("doc_id >= 900")
    out = scanned.withColumn("new", secret_scan.redacted(F.col("text"), F.col("secret_spans"))).collect()
    assert len(out) == 2
    for r in out:
        assert rest not in r["new"] and rest[::-1] not in r["new"]
        spans = [(s["start"], s["end"]) for s in r["secret_spans"]]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert {s["kind"] for s in r["secret_spans"]} == {2, 3}


IDENTIFIERS = (
    "CamelCaseIdentifierFactoryBeanProvider 123e4567-e89b-12d3-a456-426614174000 SPRING_DATASOURCE_URL getUserById2 "
    "org_apache_hadoop_mapreduce_v2 HTTPServletRequestWrapper2024 x86_64-unknown-linux-gnu 2024-01-15T10 covid19-pandemic "
    "/usr/local/lib/python3 4111-1111-1111-1111 IPv4Address Übergangsfrist2024 donaudampfschifffahrtsgesellschaft"
).split()
KEYS = "k9Xq2LmZ7pRt4W Tr0ub4dor3xY zQ7xK2pLm9vRt4sWyB8nHc3d ghp_16C7e42F292c6912E7710c838347Ae178B4a".split()


def test_identifiers_stay_clean_and_short_keys_are_found(spark):
    rows = [(i, prose(i, 200)) for i in range(50)]
    rows += [(900 + i, f"see {w} there") for i, w in enumerate(IDENTIFIERS)] + [(950 + i, f"see {w} there") for i, w in enumerate(KEYS)]
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["secret_spans"]] for r in secret_scan.scanned(frame(spark, rows)).collect()}
    assert not [w for i, w in enumerate(IDENTIFIERS) if got[900 + i]]
    assert [got[950 + i] for i in range(len(KEYS))] == [[(4, 3, 4 + len(w))] for w in KEYS]


def test_ordinary_samples_hold_every_word_of_every_text(spark):
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05d}")
    rows = [(i, "some words of each row " * 5 + f"own{letters(i)} again{letters(i % 7)}") for i in range(1500)]
    got = {}
    for r in secret_scan.ordinary_samples(frame(spark, rows)).collect():
        for word in set(re.findall(r"own[a-j]{5}|again[a-j]{5}", r["token"].lower())):
            got.setdefault(word, set()).add(r["times"])
    want = {f"own{letters(i)}": {1} for i in range(1500)}
    want |= {f"again{letters(k)}": {len(range(k, 1500, 7))} for k in range(7)}
    assert got == want


def test_more_of_the_same_corpus_gives_the_same_model(spark):
    rows = [(i, prose(i, 300)) for i in range(60)]
    of = lambda some: secret_scan.train(secret_scan.random_samples(spark, 2000).union(secret_scan.ordinary_samples(frame(spark, some))))
    once, often = of(rows * 3), of(rows * 12)
    assert max(abs(a - b) for a, b in zip(once, often, strict=True)) < 0.5


def brute_tokens(text, ratios, limit):
    """Tokens of the text without its patterns' spans, in plain Python."""
    rest = list(text)
    for a, _, b in brute_spans(text):
        rest[a:b] = " " * (b - a)
    rest = "".join(rest)
    sign = secret_scan.ALPHABET
    score = lambda w: sum(ratios[sign.index(a) * len(sign) + sign.index(b)] for a, b in zip(w, w[1:]))
    plain = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9+/_=-]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", rest):
        beside = rest[m.start() - 1 : m.start()] + rest[m.end() : m.end() + 1]
        if not plain.fullmatch(m[0]) and not any(c.isalpha() for c in beside) and score(m[0]) > limit:
            out.append((m.start(), 3, m.end()))
    return out


def test_model_spans_match_brute_force_in_long_texts(spark):
    r = random.Random(9)
    sign = "ABCDEFabcdefghijkXYZ0123456789+/_-"
    word = lambda: "".join(r.choice(sign) for _ in range(r.randrange(4, 24)))
    rows = [(i, " ".join(r.choice([word(), prose(r.randrange(99), 3), "é" + word(), 'token="0123456789abcdef0"']) for _ in range(n))) for i, n in enumerate([5, 50, 3000, 0])]
    samples = secret_scan.random_samples(spark, 2000).union(secret_scan.ordinary_samples(frame(spark)))
    samples = common.materialise(samples, "samples")
    ratios = secret_scan.train(samples)
    limit = secret_scan.threshold(samples, ratios)
    got = {x["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in x["secret_spans"]] for x in secret_scan.scanned(frame(spark, rows), samples).collect()}
    rounded = [float(f"{x:.6g}") for x in ratios]
    for i, text in rows:
        assert got[i] == sorted(brute_spans(text) + brute_tokens(text, rounded, limit))
    assert sum(s[1] == 3 for s in got[2]) > 300


def test_redaction_covers_every_span(spark):
    scanned = secret_scan.scanned(frame(spark))
    out = scanned.withColumn("new", secret_scan.redacted(F.coalesce("text", F.lit("")), F.col("secret_spans"))).collect()
    for r in out:
        text, want, at = r["text"] or "", "", 0
        for s in r["secret_spans"]:
            if s["start"] >= at:
                want += text[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        assert r["new"] == want + text[at:]


# packing


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.packed(packing.pieces(frame(spark), with_ids=True)).collect()
    by_doc = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by_doc[r["doc_id"]].append(r)
    want = defaultdict(Counter)
    for i, t in documents():
        want[i][tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,)] += 1
    for i, rows in by_doc.items():
        assert sum(r["length"] for r in rows) == sum(len(ids) * n for ids, n in want[i].items())
        if sum(want[i].values()) == 1:
            whole = tuple(x for r in sorted(rows, key=lambda r: r["start"]) for x in r["ids"])
            assert whole == next(iter(want[i]))
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sorted(used) == list(range(len(used)))


def test_patterns_hold_the_histogram_with_little_padding():
    rng = np.random.default_rng(1)
    histogram = dict(Counter(np.minimum(rng.lognormal(5.5, 1, 50_000).astype(int) + 1, 2048).tolist()))
    found = packing.patterns(histogram)
    total = Counter()
    for count, lengths in found:
        assert sum(lengths) <= 2048
        for length in lengths:
            total[length] += count
    assert total == Counter(histogram)
    tokens = sum(k * v for k, v in histogram.items())
    assert sum(c for c, _ in found) * 2048 <= tokens * 1.01 + 2048
    assert len(found) <= 3 * len(histogram)


def test_encoder_equals_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.Encoder(packing.default_tokenizer())

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from([*"ab's dt 1\n\t\r\x0b\x1c\x85 　é😀.<|>", "<|endoftext|>"]), max_size=30).map("".join))
    def check(text):
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids

    check()


# SentencePiece


def test_sentence_pieces_equal_the_library():
    import sentencepiece
    from hypothesis import given, settings
    from hypothesis import strategies as st

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    codec = sentence_pieces.Codec(sentence_pieces.default_model())

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(st.sampled_from(list("theran  .,\n-=▁éß日😀<0xA>")), max_size=40), min_size=1, max_size=8))
    def check(texts):
        for text, ids in zip(texts, codec.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
            assert codec.decode(ids) == library.decode(library.encode(text))

    check()
    long = ["th" * 2000 + " er", "=" * 700, " " * 300]
    for text, ids in zip(long, codec.encode(long), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)


def test_unigram_models_take_the_path_of_highest_sum(tmp_path):
    """A model put together by hand, against the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    r = random.Random(4)
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = 1
    model.trainer_spec.unk_id = 0
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    pieces = ["▁", *"abcd", *{r.choice(["", "▁"]) + "".join(r.choice("abcd") for _ in range(r.randrange(2, 5))) for _ in range(60)}]
    model.pieces.add(piece="<unk>", score=0, type=2)
    for p in sorted(set(pieces)):
        model.pieces.add(piece=p, score=-r.uniform(1, 9) * (3 if len(p) == 1 else 1), type=1)
    path = f"{tmp_path}/unigram.model"
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["".join(r.choice("abcd  ") for _ in range(r.randrange(0, 30))) for _ in range(200)]
    codec = sentence_pieces.Codec(path)
    score = lambda ids: sum(model.pieces[i].score for i in ids)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        got, want = np.frombuffer(ids, "<u4").tolist(), library.encode(text)
        # Paths of the same sum: the library's order of adding decides.
        assert got == want or abs(score(got) - score(want)) < 1e-4 and codec.decode(ids) == library.decode(want), text


def test_sentence_pieces_round_trip_every_document(spark):
    got = sentence_pieces.encoded(frame(spark)).collect()
    want = Counter((i, hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()) for i, t in documents())
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == want
    assert all(len(r["ids"]) == r["n_ids"] for r in got)


# personal data

PERSONAL = [
    (1, "Write to anna.92@mail6.example.com or call +1 (017) 555-7713 now."),
    (2, "Call +1 (017) 555-7713, card 4111111111111111, host 161.17.88.162. Version 1.2.3."),
    (3, "Mrs. Keller met Peter Moreau. Keller said that Peter left; Иван Орлов stayed."),
    (4, "anna.92@mail6.example.com again"),
    (4, "anna.92@mail6.example.com again"),
    (5, None),
    (6, ""),
    (7, "nothing here at all, not even 12345"),
]


def test_surrogates_are_consistent_distinct_and_of_the_same_format(spark):
    got = pii.pseudonymised(frame(spark, PERSONAL), pii.key_of("k")).collect()
    assert len(got) == len(PERSONAL)
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[5] is None and text[6] == "" and text[7] == dict(PERSONAL)[7]
    mail = re.search(r"[a-z]+\.\d\d@[a-z]+\d\.[a-z]+\.com", text[1])[0]
    assert mail != "anna.92@mail6.example.com" and text[4] == f"{mail} again"
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", text[1])[0]
    assert phone in text[2] and phone not in PERSONAL[0][1]
    card = re.search(r"card (\d{16}),", text[2])[1]
    assert card != "4111111111111111" and pii.luhn(card) and "Version 1.2.3." in text[2]
    surname = re.match(r"Mrs\. (\w+) met (\w+) (\w+)\. (\w+) said that (\w+) left; (\w+) (\w+) stayed\.", text[3])
    assert surname[1] == surname[4] != "Keller" and surname[2] == surname[5] != "Peter"
    ends = pii.SYLLABLES["latin"][3], pii.SYLLABLES["cyrillic"][3]
    assert surname[2].endswith(tuple(ends[0]["m"])) and surname[6].endswith(tuple(ends[1]["m"])) and surname[7] != "Орлов"
    again = pii.pseudonymised(frame(spark, PERSONAL), pii.key_of("other")).collect()
    assert {r["doc_id"]: r["text"] for r in again}[4] != text[4]


def replaced(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymised(rows, pii.key_of("k")).orderBy("doc_id").collect()]


def test_all_spellings_of_a_value_get_one_surrogate(spark):
    out = replaced(
        spark,
        "Mrs. Keller came. Anna Keller left. Anna came back.",
        "card 4111111111111111 or 4111 1111 1111 1111 or 4111-1111-1111-1111",
        "call +1 (017) 555-7713 or +10175557713 or +1-017-555-7713",
        "write to Anna.K9@Mail.Example.com or anna.k9@mail.example.com",
        "John Smith met Emily Jones; call (555) 123-4567 or 555-123-4567",
        "Анна Орлова и Иван Орлов; Орлова ушла",
    )
    m = re.fullmatch(r"Mrs\. (\w+) came\. (\w+) (\w+) left\. (\w+) came back\.", out[0])
    assert m[1] == m[3] != "Keller" and m[2] == m[4] != "Anna" and m[2].endswith(tuple(pii.SYLLABLES["latin"][3]["f"]))
    cards = re.findall(r"\d[\d -]+\d", out[1])
    assert len({pii.digits_of(c) for c in cards}) == 1 and [re.sub(r"\d", "d", c) for c in cards] == ["d" * 16, " ".join(["dddd"] * 4), "-".join(["dddd"] * 4)]
    phones = re.findall(r"\+1[\d ()-]+\d", out[2])
    assert len(phones) == 3 and len({pii.digits_of(p) for p in phones}) == 1 and phones[1] != "+10175557713"
    mails = re.findall(r"\S+@\S+", out[3])
    assert mails[0].lower() == mails[1] != "anna.k9@mail.example.com" and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z]\d@[A-Z][a-z]{3}\.[A-Z][a-z]{6}\.com", mails[0])
    assert not {"John", "Smith", "Emily", "Jones"} & set(re.findall(r"\w+", out[4]))
    numbers = re.findall(r"\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4}", out[4])
    assert len(numbers) == 2 and pii.digits_of(numbers[0]) == pii.digits_of(numbers[1]) != "5551234567"
    words = re.findall(r"\w+", out[5])
    assert words[1] == words[5] == words[4] + "а" and words[4] != "Орлов"


def test_names_that_differ_are_shown_differently(spark):
    pool = sorted({a + b for a in ("Ak", "Br", "Cl", "Dr", "Fr", "Gr", "Kr", "Pr", "St", "Tr") for b in "alden onson ewitt ukova istry ander elman orfel usman inger addox".split()})
    texts = [f"Mr. {w.capitalize()} left. Paul {w.capitalize()} stayed." for w in pool]
    out = replaced(spark, *texts)
    shown = [re.match(r"Mr\. (\w+) left\. \w+ (\w+) stayed", t) for t in out]
    assert all(m[1] == m[2] for m in shown) and len({m[1] for m in shown}) == len(pool) and not {m[1] for m in shown} & {w.capitalize() for w in pool}


def test_persons_of_a_recogniser_and_columns_of_any_name(spark):
    rows = [(1, "Zork Blat spoke to Quux.", [(0, 9, "Zork", "m"), (19, 23, "", "f")], "a", b"b", 3), (2, None, None, "x", b"y", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p array<struct<start:int,end:int,given:string,gender:string>>, edits string, digest_ binary, row int")
    got = {r["doc_id"]: r for r in pii.pseudonymised(df, pii.key_of("k"), persons_col="p").collect()}
    assert re.fullmatch(r"\w+ \w+ spoke to \w+\.", got[1]["text"]) and not {"Zork", "Blat", "Quux"} & set(re.findall(r"\w+", got[1]["text"]))
    assert got[1]["pii_spans"] == "person:0:9,person:19:23" and got[2]["text"] is None
    assert [(r["edits"], bytes(r["digest_"]), r["row"]) for r in (got[1], got[2])] == [("a", b"b", 3), ("x", b"y", 4)]


def test_surrogates_collide_with_nothing(spark):
    entities = [("surname", f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(600)] + [("given", f"{n}|f") for n in pii.GIVEN["latin", "f"]] + [("number", f"{i:013d}") for i in range(50)]
    df = common.materialise(spark.createDataFrame(entities, "kind string, entity string"), "entities")
    got = collected(pii.surrogates(df, pii.key_of("k")), "kind", "entity", "surrogate")
    assert len(got) == len(entities) == len({(k, s) for k, _, s in got})
    assert not {(k, s) for k, _, s in got} & set(entities)


def test_the_permutation_is_one():
    for size in (1, 2, 10, 257, 1000):
        assert sorted(pii.permuted(i, size, b"k", "t") for i in range(size)) == list(range(size))


def test_every_detected_text_passes_the_hint():
    for _, t in PERSONAL:
        if t and pii.detect(t):
            assert any(re.search(h, t) for h in pii.HINTS)


# WARC

PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://c/\r\nx", ""), (None, "u", "<p>é</p>"), (9, "http://d/", "x" * 300_000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "e") for p in PAGES], "page_id long, url string, html string, record_type string")
    root = f"file://{tmp_path}/out"
    manifest = warc.write(pages, root).collect()
    assert sum(r["records"] for r in manifest) == len(PAGES) + len(manifest)
    got = warc.read(spark, root).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len((h or "").encode()), warc.sha1_base32((h or "").encode())) for i, _, h in PAGES)
    kinds = defaultdict(list)
    for r in got:
        kinds[r["page_id"]].append((r["record_type"], r["refers_to"]))
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == next((h or "").encode() for i, _, h in PAGES if i == r["page_id"])
    assert kinds[1] == [("revisit", 2)] and sorted(kinds[2]) == [("response", None), ("revisit", 2)]
    assert kinds[3] == [("revisit", 4)] and kinds[4] == [("response", None)] and kinds[None] == [("response", None)]


def test_warc_frames_start_with_a_dictionary_and_stand_alone():
    import io

    import zstandard

    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, sample_bytes=50_000)
    blocks = [prose(i, 80).encode() for i in range(300)]
    for b in blocks:
        writer.add(warc._record([("WARC-Type", "response")], b))
    writer.close()
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    size = int.from_bytes(data[4:8], "little")
    assert data[8:12] == zstandard.train_dictionary(1024, [b"abcdefgh%d" % (i * i) * 9 for i in range(900)]).as_bytes()[:4]  # a trained one
    assert [b for _, b in warc.records(data)] == blocks
    end = warc._frame_end(memoryview(data), 8 + size)
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompress(data[8 + size : end])
    assert blocks[0] in first


def test_a_task_begins_another_archive_when_one_is_full(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", prose(i, 400)) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(pages, f"file://{tmp_path}/out", archive_bytes=20_000).collect()
    assert len(manifest) > 3 and sum(r["records"] for r in manifest) == 300 + len(manifest)
    assert sorted(r["page_id"] for r in warc.read(spark, f"file://{tmp_path}/out").collect()) == list(range(300))


def test_no_pages_no_archives(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(empty, f"file://{tmp_path}/none").count() == 0


# top-k search


def brute_topk(rows, k=5):
    usable = [(i, [np.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(usable):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for m, (i, b) in enumerate(usable) if m != n and len(b) == len(a))[:k]
            out += [(q, r + 1, i, int(-s)) for r, (s, i) in enumerate(best)]
    return Counter(out)


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties, some of them queries
    rows += [(500, None), (550, [float("nan")] * 8), (600, [None] * 8), (None, [1.0] * 8), (650, []), (700, [1.0] * 3), (701, [2.0] * 3), (1, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = topk_search.search(df, F.col("vec_id") % 50 == 0, cell_rows=20, run=30, block=9)
    assert Counter(collected(got, "query_id", "rank", "vec_id", "score")) == brute_topk(rows)


@pytest.mark.parametrize("large", [2.0**20, 3e6, 1e15, 1e30])
def test_topk_of_large_numbers_is_exact(spark, large):
    rows = [(0, [large, 1.0, -1.0])] + [(i, [large if i % 7 else -large, float(i % 5), float(i % 3)]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.search(df, F.col("vec_id") % 50 == 0, cell_rows=8)
    want = brute_topk(rows)
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    if large < 1e15:
        assert Counter(collected(got, "query_id", "rank", "vec_id", "score")) == Counter((q, r, i, held(x)) for q, r, i, x in want)
    else:  # every score is held at a bound of the integers
        got = collected(got, "query_id", "rank", "vec_id", "score")
        assert sorted(x[:2] for x in got) == sorted(x[:2] for x in want) and {x[3] for x in got} == {held(x[3]) for x in want}
        assert all(x[2] % 7 for x in got)


def test_topk_of_empty_tables_and_of_tables_without_queries(spark):
    for rows in ([], [(1, [1.0, 2.0]), (2, [3.0, 4.0])], [(50, None), (100, [])], [(0, [1.0])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert topk_search.search(df, F.col("vec_id") % 50 == 0).count() == 0


def clustered(count, seed=2):
    rng = np.random.default_rng(seed)
    return np.floor(rng.normal(size=(count, 6)) * 50 + np.eye(6)[rng.integers(0, 6, count)] * 2000)


def test_cover_tree_invariants():
    points = clustered(3000)

    def check(node):
        away = lambda rows, c: np.sqrt(((points[rows] - c) ** 2).sum(1))
        assert away(node.rows, node.centre).max() <= node.radius + 1e-6
        if not node.children:
            assert len(node.rows) <= 64 or node.radius == 0
            return
        assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        centres = np.array([c.centre for c in node.children])
        assert (centres[0] == node.centre).all()  # nesting
        for n, c in enumerate(node.children):
            assert away(c.rows, c.centre).max() <= node.cover + 1e-6  # covering
            others = np.sqrt(((np.delete(centres, n, 0) - c.centre) ** 2).sum(1))
            assert others.min() >= node.cover - 1e-6  # separation
            check(c)

    check(topk_search.cover_tree(points, leaf=64))


def visited(bounds):
    """Pairs of a query and a point that are compared, with and without bounds known before."""
    points = clustered(3000)
    seen, offer = [], topk_search.Queries.offer
    topk_search.Queries.offer = lambda self, q, p, o, i: (seen.append(len(q) * len(p)), offer(self, q, p, o, i))[1]
    try:
        least = np.full(200, -np.inf)
        if bounds:
            least = np.sort(points[:200] @ points.T, 1)[:, -6]
        queries = topk_search.Queries(points[:200], np.arange(200), least)
        for at in range(0, 3000, 300):
            queries.search(points[at : at + 300], np.arange(at, at + 300), np.arange(at, at + 300), leaf=64)
    finally:
        topk_search.Queries.offer = offer
    return sum(seen), [[(-s, i) for s, i in best] for best in queries.found]


def test_dual_trees_prune_and_bounds_prune_more():
    few, found = visited(True)
    some, same = visited(False)
    points = clustered(3000)
    scores = points[:200] @ points.T
    np.fill_diagonal(scores, -np.inf)
    want = [sorted(((float(x), i) for i, x in enumerate(row)), key=lambda p: (-p[0], p[1]))[:5] for row in scores]
    assert same == want and found == want
    assert few < some < 200 * 3000


def test_queries_know_a_bound_and_tasks_return_only_what_reaches_it(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clustered(2000))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    parts, found = [], topk_search._found
    topk_search._found = lambda *a: parts.append(found(*a)) or parts[-1]
    try:
        got = topk_search.search(df, F.col("vec_id") % 50 == 0, cell_rows=200, scale=1)
    finally:
        topk_search._found = found
    assert got.count() == 200
    assert sum(p.count() for p in parts) < 2 * 200  # of 40 queries, five each, in every task without a bound


# URL filter


def test_url_rules_and_model(spark):
    urls = ["https://a.example.net/en/1", "http://Example.NET/de/", "http://x.example.com/de/9?q=/fr/", "https://b.org/fr/2", "b.org/fr/2", "http://b.org/en/", None, "", "ftp://q.net#x", "http://notnet/", "http://é.ORG/fr/ü", "http://w.example.net"]
    urls += [f"http://good{i}.org/fr/story-{i}" for i in range(40)] + [f"http://cheap{i}.net/pills/{i}" for i in range(40)]
    urls += ["http://cheap7.com/pills/77", "http://good7.com/story-77"]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judged(df).collect()}
    assert len(got) == len(urls)

    def want(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [r.text for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return host, path, max(fits, key=len, default=None)

    verdicts = {r.text: r.verdict for r in url_filter.RULES}
    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == want(u)
        if got[i]["rule"]:
            assert got[i]["verdict"] == verdicts[got[i]["rule"]]
    assert got[len(urls) - 2]["verdict"] == "block" and got[len(urls) - 1]["verdict"] == "allow"


def test_url_scores_equal_a_plain_model(spark):
    texts = [("abab", True, 3), ("abba", True, 1), ("cccc", False, 2), ("abcc", False, 1)]
    labelled = spark.createDataFrame(texts, "symbols string, accepted boolean, n long")
    counts = {True: defaultdict(Counter), False: defaultdict(Counter)}
    for t, flag, n in texts:
        full = "^^" + t
        for i, c in enumerate(t):
            for k in range(3):
                counts[flag][full[i + 2 - k : i + 2]][c] += n

    def p(flag, ctx, c):
        lower = 1 / url_filter.SYMBOLS
        for k in range(len(ctx) + 1):
            seen = counts[flag][ctx[len(ctx) - k :]]
            if seen:
                lower = (seen[c] + len(seen) * lower) / (sum(seen.values()) + len(seen))
        return lower

    import math

    some = ["abab", "cabx", "c", "zz0"]
    got = dict(collected(url_filter.scores(spark.createDataFrame([(t,) for t in some], "symbols string"), url_filter.train(labelled)), "symbols", "score"))
    for t in some:
        full = "^^" + t
        want = sum(math.log(p(True, full[i : i + 2], c) / p(False, full[i : i + 2], c)) for i, c in enumerate(t)) / len(t)
        assert got[t] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("names", "make"), [
    (("row", "bits", "place", "word", "digest"), lambda d: exact_dedup.deduplicated(d)),
    (("row", "root", "fp", "number"), lambda d: simhash.deduplicated(d)),
    (("base", "rest", "_base", "_tokens"), lambda d: secret_scan.scanned(d)),
    (("edits", "digest_", "row", "bits"), lambda d: pii.pseudonymised(d, b"k")),
    (("symbols", "fits", "_rule"), lambda d: url_filter.judged(d.withColumnsRenamed({"doc_id": "page_id", "text": "url"}))),
])
def test_columns_of_any_name_pass_through(spark, names, make):
    extra = frame(spark, documents()[:12]).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    rows = make(extra).collect()
    assert rows and all(r[n] == f"{n}{r['doc_id'] if 'doc_id' in r else r['page_id']}" for r in rows for n in names)


@pytest.mark.parametrize("make", [
    lambda d: exact_dedup.exact_duplicates(d),
    lambda d: simhash.near_duplicates(d),
    lambda d: secret_scan.scanned(d),
    lambda d: packing.packed(packing.pieces(d)),
    lambda d: sentence_pieces.encoded(d),
    lambda d: pii.pseudonymised(d, b"k"),
    lambda d: url_filter.judged(d.withColumnsRenamed({"doc_id": "page_id", "text": "url"})),
])
def test_empty_tables_give_empty_results(spark, make):
    assert make(frame(spark, [])).count() == 0
