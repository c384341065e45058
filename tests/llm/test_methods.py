"""The methods themselves: each against enumeration, simulation or a direct computation."""

import gzip
import itertools
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from contigua.llm import audio, bpe, exact_dedup, minhash, packing, pii, secrets, substring_dedup, toxicity, warc

DOC = "doc_id long, text string"


def test_a_rule_with_too_many_clauses_scans_every_text(spark):
    rule, texts = r"[a-h][a-h]xy[0-9]+", ["an abxy12 and hhxy7", "none xy1", "gaxy0"]
    assert secrets.trigram_query(rule) is None
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), DOC), added={"wide": (rule, 0, 5)}).collect()
    assert {r.doc_id: r.spans for r in rows} == {i: ",".join(f"wide:{m.start()}:{m.end()}" for m in re.finditer(rule, t) if len(m.group()) >= 5) for i, t in enumerate(texts)}


def random_rule(rng):
    part = lambda: rng.choice(["abc", "key_", "[ab]", "[a-c]x", "(?:foo|bar)", "(?:q|[rs]t)", "[0-9]+", "z{2,3}", "y?", "(?:ab)+", "[a-z]*", "K"])
    return "".join(part() for _ in range(rng.randint(1, 4)))


def test_random_rules_lose_no_match():
    rng = random.Random(7)
    pieces = ["abc", "key_", "a", "b", "ax", "bx", "cx", "foo", "bar", "q", "rt", "st", "7", "42", "zz", "zzz", "y", "abab", "K", " ", "-"]
    for _ in range(300):
        rule = random_rule(rng)
        clauses = secrets.trigram_query(rule)
        for _ in range(30):
            text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
            if any(m.group() for m in re.finditer(rule, text)) and clauses is not None:
                low = text.lower()
                assert any(all(t in low for t in c) for c in clauses), (rule, text, clauses)


def test_random_rules_over_texts(spark):
    rng = random.Random(8)
    rules = {f"r{i}": (random_rule(rng), 0, 2) for i in range(6)}
    texts = ["".join(rng.choice(["abc", "key_", "ax", "bx", "foo", "bar", "rt", "42", "zzz", "y", "K", " "]) for _ in range(12)) for _ in range(60)]
    rows = [(None if i % 9 == 0 else i % 40, t) for i, t in enumerate(texts)]
    got = secrets.find_secrets(spark.createDataFrame(rows, DOC), added=rules).collect()

    def spans(t):
        every = [(m.start(), k, m.end(), n) for k, (n, (e, g, least)) in enumerate((secrets.BASE_RULES | rules).items()) for m in re.finditer(e, t, re.A) if len(m.group(g)) >= least]
        return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(every))

    assert sorted((r.doc_id or -1, r.spans) for r in got) == sorted((i or -1, spans(t)) for i, t in rows)


def test_packing_has_the_least_padding_of_all_boundaries(spark):
    lengths = [9] * 40 + [0, 1, 13, 14, 14, 30, 31, 47, 47, 47]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), "x") for i, n in enumerate(lengths)], DOC + ", bucket string")
    places = sorted({max(n, 1) for n in lengths})
    least = min(sum(min(e for e in [*x, 47] if e >= n) - n for n in lengths) for k in range(3) for x in combinations(places[:-1], k))
    rows = packing.pack(docs, buckets=3).collect()
    assert len(rows) == len(lengths) and sum(r.padding for r in rows) == least
    assert packing.pack(docs.limit(0)).collect() == []


def test_many_lengths_have_boundaries_as_good_as_the_quadratic_programme():
    rng = np.random.default_rng(4)
    lengths = np.unique(rng.integers(1, 30_000, 700))
    counts = rng.integers(1, 50, len(lengths))
    n, t = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    cost = np.r_[0, n[1:] * lengths - t[1:]]
    for _ in range(5):
        cost = np.array([0] + [min(cost[i] + (n[j] - n[i]) * lengths[j - 1] - (t[j] - t[i]) for i in range(j)) for j in range(1, len(n))])
    edges = np.array(packing.boundaries(lengths, counts, counts * lengths, 6))
    assert len(edges) <= 6 and ((edges[np.searchsorted(edges, lengths)] - lengths) * counts).sum() == cost[-1]


def plain_bpe(word, merges):
    rank, s = {m: i for i, m in enumerate(merges)}, list(word)
    while True:
        best = min((rank[p] for p in zip(s, s[1:]) if p in rank), default=None)
        if best is None:
            return s
        out, i = [], 0
        while i < len(s):
            if tuple(s[i : i + 2]) == merges[best]:
                out.append(s[i] + s[i + 1])
                i += 2
            else:
                out.append(s[i])
                i += 1
        s = out


def test_any_merge_list_encodes_as_merging_does():
    rng = random.Random(1)
    for trial in range(400):
        tokens, merges = ["a", "b", "c"], [("a", "b"), ("b", "c"), ("a", "bc")] if trial == 0 else []
        tokens += ["".join(m) for m in merges]
        for _ in range(rng.randint(1, 12)):
            x, y = rng.choice(tokens), rng.choice(tokens)
            if x + y not in tokens:
                merges.append((x, y))
                tokens.append(x + y)
        mine = bpe.WordBpe({t: i for i, t in enumerate(tokens)}, merges, "")
        for _ in range(10):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert [mine.name[i] for i in mine.encode(word.encode())] == plain_bpe(word, merges)


def test_expectation_maximisation_finds_the_reliabilities():
    rng = np.random.default_rng(3)
    right, counts, truth = [0.95, 0.8, 0.7], {}, {}
    for _ in range(60_000):
        y = rng.random() < 0.6
        v = tuple(int(y == (rng.random() < r)) * 2 - 1 if rng.random() < 0.9 else 0 for r in right)
        key = (5, *v, 1, 2, 0, 0)
        counts[key] = counts.get(key, 0) + 1
        truth[key] = truth.get(key, 0) + y
    m = pii.SpanModel(counts)
    assert abs(m.share[5] - 0.6) < 0.03 and all(abs(a - b) < 0.03 for a, b in zip(m.reliability[5], right))
    wrong = sum(min(n, abs((n if m.score(k) >= 0.5 else 0) - truth[k])) for k, n in counts.items())
    best = sum(min(truth[k], n - truth[k]) for k, n in counts.items())
    assert wrong <= best * 1.02


def test_the_classifier_learns_what_labelers_do_not_see():
    # Votes say nothing of half the spans; those that stand beside a letter are like the rejected ones.
    counts = {(5, 1, 1, 1, 1, 2, 0, 0): 900, (5, -1, -1, 0, 1, 2, 2, 2): 900, (5, 0, 0, 0, 1, 2, 0, 0): 50, (5, 0, 0, 0, 1, 2, 2, 2): 50}
    m = pii.SpanModel(counts)
    assert m.score((5, 0, 0, 0, 1, 2, 0, 0)) > m.score((5, 0, 0, 0, 1, 2, 2, 2))


def test_added_spans_are_all_matches_beside_base_spans():
    rng = random.Random(6)
    parts = ["call (212) 555-0142", "ssn 123-45-6789", "IBAN DE89 3704 0044 0532 0130 00", "Dr. Maria", "Mr Smith", "bob [at] site dot com", "+49 30 123 456 7890", "a.b@c.de", " ", ", ", "x", "12.34.56.78", "4111 1111 1111 1111"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 7)))
        base = pii.base_spans(t)
        every = [(m.start(), k, m.end()) for k, e in ((4, pii._SPELLED), (5, pii._LOCAL_PHONE), (6, pii._NATIONAL), (7, pii._IBAN), (8, pii._PERSON)) for m in e.finditer(t)]
        want = [x for x in every if all(e <= x[0] or s >= x[2] for s, _, e in base)]
        assert sorted(pii.added_candidates(t, base)) == sorted(want), t


def test_long_equal_prefixes_take_levels_of_bounded_width(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_RUN", 300)
    a = "q" * 1500
    rows = [(1, a + "x"), (2, a + "y"), (3, a[:700] + " " + a[700:] + "x"), (4, None), (5, " ")]
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (5, 2, False), 5: (5, 2, True)}


def test_clashing_names_stay_whole(spark):
    rows = [(1, "a b c d e f g", "k1", "g1", 1), (2, "a b c d e f g", "k2", "g2", 2), (None, "other words that nothing else has", "k3", "g3", 3), (None, "other words that nothing else has", "k3", "g3", 3)]
    docs = spark.createDataFrame(rows, DOC + ", _row string, _gone string, row long")
    kept = exact_dedup.keep_exact(docs)
    assert kept.columns == docs.columns and sorted((r._row, r._gone, r.row) for r in kept.collect()) == [("k1", "g1", 1), ("k3", "g3", 3)]
    one = minhash.keep_one(docs)
    assert one.columns == docs.columns and sorted(r.row for r in one.collect()) == [1, 3, 3]
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == 4


@pytest.mark.parametrize("weighted", [False, True])
def test_sets_and_counts_link_as_brute_force_does(spark, weighted):
    rng = random.Random(9)
    texts = []
    for _ in range(10):
        base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
        refrain = [f"r{rng.randint(0, 99)}" for _ in range(7)]
        for _ in range(5):
            w = base + refrain * rng.choice([1, 2, 9])
            w[rng.randrange(60)] = f"e{rng.randint(0, 9999)}"
            texts.append(" ".join(w))
    bags = [minhash.measured([t], weighted) for t in texts]
    label = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        a, b = bags[i], bags[j]
        x, y = (dict(zip(s[0].tolist(), n[0].tolist() if weighted else [1] * len(s[0]))) for s, n in (a, b))
        same, both = sum(min(x.get(k, 0), y.get(k, 0)) for k in x), sum(max(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y.keys())
        if same >= 0.8 * both and label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if z == old else z for z in label]
    rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOC), weighted=weighted).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(label))


def test_windows_of_rows_without_an_id(spark):
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(None, f"a{i} " + shared + f" b{i}") for i in range(7)] + [(5, shared), (5, shared + " tail"), (2, " ".join(f"u{rng.random()}" for _ in range(40)))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, DOC), block_bytes=100).collect()
    assert len(got) == len(rows)
    assert sum(r.n_removed for r in got if r.doc_id is None) == 7 * 30 and sorted(r.n_removed for r in got if r.doc_id == 5) == [0, 30]
    assert [r.n_removed for r in got if r.doc_id == 2] == [0]


def test_viterbi_finds_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    model = toxicity.LanguageModel(rng.integers(0, 9, (28, 28, 28)).astype(float), np.zeros((28, 28, 28)))
    mine, log = toxicity.Restorer(model), model.log

    def value(word):
        c = [0, 0, *(ord(x) - 96 if "a" <= x <= "z" else 27 for x in word), 0]
        return sum(log[a, b, d] for a, b, d in zip(c, c[1:], c[2:]))

    def readings(token):
        columns = []
        for m in re.finditer(r"(.)\1*", token):
            c, n = m.group(1), len(m.group())
            own = [(c, 0.0)] if c.isalpha() else []
            own += [(x, mine.SWAP) for x in toxicity.LEET.get(c, "")]
            column = [(r, s + (mine.DROP if n > 1 else 0)) for r, s in own]
            column += [(r * 2, s + (mine.DROP if n > 2 else 0)) for r, s in own if n > 1]
            column += [(r * 3, s + (mine.DROP if n > 3 else 0)) for r, s in own if n > 2 and c.isalpha()]
            columns += [column] if column else []
        for path in itertools.product(*columns):
            yield sum(s for _, s in path), "".join(r for r, _ in path)

    random.seed(4)
    for _ in range(150):
        token = "".join(random.choice("ab1!*0$eess") for _ in range(random.randint(1, 6)))
        best = max(s + value(w) for s, w in readings(token))
        got = mine.word(token)
        assert any(w == got and abs(s + value(w) - best) < 1e-9 for s, w in readings(token)), (token, got)


def test_what_is_restored_takes_the_place_of_what_stood_there():
    words = {"idiot": 50.0, "stupid": 50.0, "trash": 50.0, "shit": 50.0, "ass": 50.0, "the": 90.0, "you": 90.0, "are": 90.0}
    r = toxicity.Restorer(toxicity.LanguageModel(np.zeros((28, 28, 28)), toxicity.word_trigrams(words)))
    assert r.restored("You are (1d10t)! the TRA$H") == "you are idiot the trash" and r.restored("5h17 you") == "shit you"
    assert r.words("you a$$, s.t.u.p.i.d") >= {"you", "stupid"} and "1d10t" not in r.words("1d10t")
    # A token's reading depends on that token only, at any length.
    assert r.read("1d10t") == r.restored("1d10t plain 2nd 1990s").split()[0] and r.read("2nd") == "nd" and r.restored("hello! (yes)") == "hello yes"
    long = " ".join("stupid" * 20)
    assert r.restored("so " + long) == "so" + " stupid" * 20 and r.restored("y o u a r e s t u p i d") == "you are stupid" and r.restored("stu" + "u" * 90 + "pid") == "stupid" and len(r.restored("q1w" * 20_000)) > 20_000


def test_resampling_is_a_direct_convolution():
    rng = np.random.default_rng(1)
    x = rng.normal(size=200).astype(np.float32)
    up, down, taps = audio.UP, audio.DOWN, audio.TAPS
    h = np.zeros(up * taps)
    for p, row in enumerate(audio.phases()):
        h[p::up] = row[::-1]
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, h)  # zero stuffing, filter, every third
    y = audio.resample(np.concatenate([np.zeros(taps - 1, np.float32), x]))
    assert np.allclose(y, full[::down][: len(y)], atol=1e-5) and len(y) == len(x) * up // down


def test_log_mel_is_a_direct_transform():
    raw = bytes((np.sin(np.arange(960) / 5) * 90 + 128).astype(np.uint8))
    mel, energy = audio.log_mel(raw)
    x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    y = audio.resample(np.concatenate([np.zeros(audio.TAPS - 1), x, np.zeros(800)]).astype(np.float32))
    n, k = np.arange(audio.FRAME), np.arange(audio.FRAME // 2 + 1)
    for i in range(len(mel)):
        frame = y[i * audio.HOP : i * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME + 1)[: audio.FRAME]
        power = np.abs((frame[None] * np.exp(-2j * np.pi * k[:, None] * n / audio.FRAME)).sum(1)) ** 2
        assert np.allclose(mel[i], np.log(power @ audio.mel_bank(audio.RATE * audio.UP / audio.DOWN) + 1e-6), atol=2e-3)
        assert abs(energy[i] - 10 * np.log10((frame**2).mean() + 1e-9)) < 1e-2


def test_segments_start_high_and_end_low():
    rng = np.random.default_rng(2)
    for _ in range(200):
        e = rng.normal(size=rng.integers(1, 60)).astype(np.float32)
        up, low, on, want = float(e.mean()) + 0.5 * float(e.std()) + 1e-3, float(e.mean()), False, []
        for i, v in enumerate(e):
            if v >= up and not on:
                on = True
                want.append([i, len(e)])
            elif v < low and on:
                on = False
                want[-1][1] = i
        assert audio.segments(e) == [tuple(w) for w in want]


def test_tensors_have_one_shape_in_store_and_result(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "ü" * 5000), (3, None), (3, None)], DOC)
    media = audio.store(docs)
    tables = [audio.from_ipc(r.batch) for r in audio.tensor_batches(media).collect()]
    assert all(t.schema.field("tensor").type == audio.TENSOR for t in tables)
    stored = {i: x for t in tables for i, x in zip(t.column("doc_id").to_pylist(), t.column("tensor").combine_chunks().to_numpy_ndarray())}
    rows = audio.features(media).collect()
    assert len(rows) == 4 and all(np.array_equal(np.array(r.tensor, np.float32).reshape(audio.BINS, audio.MELS), stored[r.doc_id]) for r in rows)
    for r in rows:
        mel, energy = audio.log_mel(audio.payload_of({1: "short", 2: "ü" * 5000}.get(r.doc_id))[1])
        second = audio.HOP * audio.DOWN / audio.UP / audio.RATE
        assert np.allclose([(s.start, s.end) for s in r.spans], [(a * second, b * second) for a, b in audio.segments(energy)], atol=1e-5)
    tensors = audio.as_tensors(pa.array([r.tensor for r in rows], pa.list_(pa.float32())))
    assert tensors.type == audio.TENSOR and tensors.to_numpy_ndarray().shape == (4, audio.BINS, audio.MELS)
    with pytest.raises(ValueError):
        other = pa.fixed_shape_tensor(pa.float32(), (2, 2))
        audio.from_ipc(audio.to_ipc(pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(other, pa.array([[1, 2, 3, 4]], pa.list_(pa.float32(), 4)))], names=["tensor"])))


def test_warc_files(spark, tmp_path):
    assert [warc.warc_name(x) for x in ("my.archive-1.arc", "a.arc.gz", "plain")] == ["my.archive-1.warc", "a.warc.gz", "plain.warc"]
    pages = spark.createDataFrame([(i, f"http://h/{i % 4}", "same" if i % 2 else f"page {i}") for i in range(12)], "page_id long, url string, html string")
    made = warc.convert_arcs(warc.write_arcs(pages, archive_bytes=200))
    told = {r.archive: r.bytes for r in warc.export(made, str(tmp_path / "out")).collect()}
    records = []
    for name, size in told.items():
        data = (tmp_path / "out" / name).read_bytes()
        assert len(data) == size and name.endswith(".warc")
        for h, block in warc.warc_records(data):
            records.append(h["WARC-Type"])
            assert h["WARC-Type"] == "warcinfo" or h["WARC-Block-Digest"] == "sha1:" + warc.digest(block)
        assert gzip.decompress(data).startswith(b"WARC/1.0")
    assert records.count("response") == 7 and records.count("revisit") == 5
    broken = warc.warc_record({"WARC-Type": "response", "WARC-Record-ID": "x", "WARC-Payload-Digest": "sha1:" + warc.digest(b"a"), "WARC-Block-Digest": "sha1:" + warc.digest(b"b")}, b"a")
    with pytest.raises(Exception, match="block of x"):
        warc.read_warcs(spark.createDataFrame([(bytearray(broken),)], "content binary")).collect()


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "a clean text of some words here", "k", 1), (2, "a clean text of some words here", "k", 2), (None, None, "k", 3), (4, "", "k", 4), (5, "mail bob@example.com now", "k", 5)]
    schema = DOC + ", _row string, _gone long"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0), (5, 0)] if data else [], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted((r.doc_id or -1) for r in got) == [1, 4, 5] and {r.doc_id: r.n_tokens for r in got}[5] == 3
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
