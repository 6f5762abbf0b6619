"""Each operator against a plain form of its definition, on awkward rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_cases import documents, empty, long_text, lower_ascii, rows, sha, texts, words

from tidemark.llm import chat, decontam, exact_dedup, langid, mixing, near_dedup, pfor, pii, secrets, substring_dedup


# ---------------------------------------------------------------- op1

RULES = [("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]


def plain_secrets(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(RULES):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [x for _, _, x in sorted(found)]


def test_secrets(spark):
    want = []
    for d, t in texts():
        s = plain_secrets(t)
        n = [sum(x.startswith(k) for x in s) for k in ("assign", "access", "hex")]
        want.append((d, *n, sha(",".join(s)), ",".join(s)))
    assert rows(secrets.secret_digest(documents(spark))) == sorted(want, key=repr)
    assert sum(len(plain_secrets(t)) for _, t in texts()) >= 5
    assert rows(secrets.secret_digest(empty(spark))) == []


def test_ledger_is_incremental(spark, tmp_path):
    path = str(tmp_path / "ledger")
    v1 = spark.createDataFrame([("a", 1, "token=abcdefghijkl"), ("b", 1, "token=abcdefghijkl"), ("c", 1, "no")], "path string, version int, text string")
    v2 = spark.createDataFrame([("a", 2, "now clean"), ("d", 1, "no")], "path string, version int, text string")
    secrets.scan(v1, path, ["path", "version"]).collect()
    assert spark.read.parquet(path).count() == 2 * 3
    both = secrets.scan(v1.union(v2), path, ["path", "version"])
    assert {(r.path, r.version) for r in both.collect() if r.findings} == {("a", 1), ("b", 1)}
    assert spark.read.parquet(path).count() == 3 * 3
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{8,}", 0, 8))
    secrets.scan(v2, path, ["path"], rules=newer).collect()
    ledger = spark.read.parquet(path)
    assert ledger.count() == 3 * 3 + 2 and ledger.filter(f"rule = '{newer[2].key}'").count() == 2
    changed = (*secrets.RULES[:2], secrets.Rule("hex", 1, "[0-9a-f]{2,}", 0, 2))
    assert changed[2].key != secrets.RULES[2].key


# ---------------------------------------------------------------- op2


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks_round_trip(n, tmp_path):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.02, rng.integers(0, 2**32, n), rng.integers(1000, 1000 + 2 ** int(rng.integers(0, 16)), n)).astype("<u4")
    path = tmp_path / "x.tpf"
    cuts = sorted(rng.integers(0, n + 1, 5).tolist())
    with open(path, "wb") as f:
        w = pfor.Writer(f, 0.9)
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, n])):
            w.add(None if k == 2 else k - 1, ids[a:b].tobytes())
        w.close()
    with open(path, "rb") as f:
        got = list(pfor.Reader(f, path.stat().st_size).documents())
    assert [g[0] for g in got] == [-1, 0, None, 2, 3, 4]
    assert np.array_equal(np.concatenate([g[3] for g in got]), ids)
    assert [g[1] for g in got] == [0, *cuts]


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want, start = [], 0
    for d, text in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(pfor.token_output(documents(spark), path)) == sorted(want, key=repr)
    assert rows(pfor.token_output(empty(spark), path)) == []


def test_encoder_agrees_with_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(1)
    alphabet = "abcXYZ019 '\n\t.,!?-_éÉßÿ×÷µ́  中\U0001f600<|>İſ\x1c\x85"
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        t, e = Tokenizer.from_file(path), pfor.Encoder(path)
        for _ in range(1500):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
            assert np.frombuffer(e.ids(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, (name, s)


# ---------------------------------------------------------------- op3


def thue_morse(n, a="a", b="b"):
    """A word that collides with its opposite under polynomial hashes modulo 2**64."""
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_words_that_fool_polynomials(spark):
    docs = [(k, " ".join([f"w{i}" for i in range(6)] + [w] + [f"v{i}" for i in range(6)])) for k, w in enumerate((thue_morse(1024), thue_morse(1024, "b", "a")))]
    docs += [(2, " ".join(thue_morse(64, f"x{i}", f"y{i}") for i in range(13))), (3, " ".join(thue_morse(64, f"y{i}", f"x{i}") for i in range(13)))]
    assert {r.n_removed for r in substring_dedup.substring_dedup(documents(spark, docs)).collect()} == {0}
    assert all(r.kept for r in near_dedup.near_duplicates(documents(spark, docs)).collect())


def test_word_hashes_tell_words_apart():
    """All short words, long ones that differ in one byte, and words across the piece limit."""
    import itertools

    import pyarrow as pa
    from tidemark.llm import wordhash

    words_ = ["".join(c) for n in (1, 2, 3) for c in itertools.product("abcdefgh", repeat=n)] + ["x" * n + c for n in (7, 8, 15, 16, 255, 256, 257, 5000) for c in "pq"]
    for key in (1, 2**63 + 5):
        got = [w.hashes.tolist() for _, _, w in wordhash.text_words(pa.array([" ".join(words_), None, "\n".join(words_)]), keys=(key,))]
        flat = [h for part in got for h in part]
        assert flat[: len(words_)] == flat[len(words_) :] and len(set(flat)) == len(words_)
    long = pa.array(["word " * 200_000 + "end"])
    (_, _, w), = wordhash.text_words(long)
    assert len(w.hashes) == 200_001 and len(set(w.hashes.tolist())) == 2


def plain_substring(docs, n=13):
    key = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, float("inf")), key(d))
    out = []
    for d, t in docs:
        w = words(t)
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < key(d) for j in range(i, i + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), sha(kept), kept))
    return sorted(out, key=repr)


def test_substring(spark):
    assert rows(substring_dedup.substring_dedup(documents(spark), chunk_words=500)) == plain_substring(texts())
    assert rows(substring_dedup.substring_dedup(empty(spark))) == []


def test_substring_random(spark):
    rng = random.Random(5)
    base = [f"t{rng.randrange(50)}" for _ in range(400)]
    docs = []
    for d in range(60):
        a = rng.randrange(380)
        docs.append((rng.randrange(30), " ".join([f"u{d}"] * rng.randrange(9) + base[a : a + rng.randrange(40)] + [f"v{d}"] * rng.randrange(9))))
    got = rows(substring_dedup.substring_dedup(documents(spark, docs), chunk_words=120, owners=3))
    assert got == plain_substring(docs)


# ---------------------------------------------------------------- op4


def fill(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left, all_w = total - sum(cap * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        t = {s: cap * sizes[s] if s in full else left * w[s] / all_w for s in names}
        over = {s for s in names if s not in full and t[s] > cap * sizes[s]}
        if not over:
            return t
        full |= over


def test_mix(spark):
    rng = random.Random(2)
    sources = ["web", "Web", "books", "é", None, "code", "news"]
    docs = []
    for k in range(700):
        s = sources[0] if k % 3 == 0 else rng.choice(sources)
        docs.append((k // 2 if k < 20 else k, "w " * int(rng.paretovariate(1.2) * 20), None, s, 0, 0, "", "", 0, 0))
    docs.append((9000, None, None, "web", 0, 0, "", "", 0, 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, i long, kind string, class string, key long, chunk int").repartition(4)
    first = rows(mixing.mix_report(df))
    assert first == rows(mixing.mix_report(df.repartition(2))) and len(first) == len(docs)
    sizes = collections.Counter()
    for d in docs:
        sizes[d[3]] += len(words(d[1]))
    by_size = {v: k for k, v in sizes.items()}
    want, taken = fill(sizes), collections.Counter()
    for _, size, source_size, target, got, copies in first:
        s = by_size[source_size]
        assert abs(target - want[s]) < 1e-6 and got == copies * size and 0 <= copies <= 2
        taken[s] += got
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 40), (s, taken[s], t)
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_mix_edges(spark):
    assert rows(mixing.mix_report(empty(spark))) == [] and rows(mixing.apply_mix(empty(spark))) == []
    got = mixing.mix_report(documents(spark))
    assert got.count() == len(texts()) and got.filter("taken > 2 * size").count() == 0
    blank = mixing.mix_report(documents(spark, [(1, None), (2, " ")])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


# ---------------------------------------------------------------- op5


def plain_chat(lines):
    """Every perspective by plain loops."""
    safe = lambda s: s.replace("<|", "<\u200b|").replace("|>", "|\u200b>")
    talks = collections.defaultdict(list)
    for k, (c, turn, role, text) in enumerate(lines):
        talks[(c, k if c is None else None)].append((turn is not None, turn or 0, role or "unknown", text or ""))
    out = []
    for (c, _), talk in talks.items():
        for who in {x[2] for x in talk} - {"system"}:
            shown, mask = "", []
            for _, _, role, text in sorted(talk):
                shown += "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={safe(role)}|>\n"
                start = len(shown)
                shown += safe(text) + "<|end|>\n"
                if role == who:
                    mask.append(f"{start}:{len(shown)}")
            out.append((c, who, len(talk), shown, ",".join(mask)))
    return sorted(out, key=repr)


def test_chat(spark):
    lines = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, 3, None, None), (None, 0, "ann", "x"), (None, 0, "ann", "x"), (None, 1, "system", "y"), (2, 0, "system", "alone"), (3, None, "", "late"), (3, 600, "a<|n|>n", "far"), (3, 601, "ann", "\U0001f600 " + long_text(60_000))]
    lines += [(4, t, f"p{t % 2}", f"turn {t}") for t in range(1200)]
    df = spark.createDataFrame([(*x, 1, "h", "b", 7, 0) for x in lines], "conv_id long, turn long, role string, text string, n int, head string, body string, at int, lines int").repartition(3)
    got = rows(chat.chat_report(df))
    assert got == plain_chat(lines) and [r[:3] for r in got if r[0] == 4] == [(4, "p0", 1200), (4, "p1", 1200)]
    bob = chat.rotate(df).filter("conv_id = 1 and perspective = 'bob'").first()
    assert [bob.text[m.start : m.stop] for m in bob.mask] == ["yo<|end|>\n", "yo<|end|>\n"]
    assert bob.text.startswith("<|system|>\nrules<|end|>\n<|user name=ann|>\nhi <\u200b|end|\u200b><|end|>\n<|assistant|>\n")
    assert chat.rotate(df.limit(0)).count() == 0


# ---------------------------------------------------------------- op6


def plain_near(docs, percent=85):
    sets = []
    for _, t in docs:
        w = words(lower_ascii(t))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in range(len(docs)):
        groups[find(k)].append(docs[k][0])
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, len(sets[k]), least[find(k)], d == least[find(k)]) for k, (d, _) in enumerate(docs)), key=repr)


def test_shingles_are_real_words():
    rng = random.Random(12)
    bodies = [b" ".join(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(5, 40))) for _ in range(60)]
    row, x = near_dedup.shingle_ids(bodies)
    want = [(k, tuple(w[i : i + 5])) for k, w in enumerate(b.split(b" ") for b in bodies) for i in range(len(w) - 4)]
    assert row.tolist() == [k for k, _ in want] and len(set(zip(x.tolist(), [s for _, s in want]))) == len(set(x.tolist())) == len({s for _, s in want})
    sets = [{s for k, s in want if k == d} for d in range(60)]
    for percent in (50, 85):
        got = near_dedup._compare(bodies[0], bodies[1:], percent)
        assert got.tolist() == [100 * len(sets[0] & s) >= percent * len(sets[0] | s) for s in sets[1:]]


def test_near_pairs_at_the_limit(spark):
    """Planted pairs just at and just below 85 %, and 300 a little above: none is lost."""
    docs = []
    for k in range(300):
        w = [f"p{k}w{i}" for i in range(204)]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: (174 if k < 150 else 175 + k % 20) if k % 3 else 173]))]
    got = rows(near_dedup.near_duplicates(documents(spark, docs)))
    assert got == plain_near(docs) and sum(not r[3] for r in got) == sum(1 for k in range(300) if k % 3)


def test_near(spark):
    assert rows(near_dedup.near_duplicates(documents(spark))) == plain_near(texts())
    assert rows(near_dedup.near_duplicates(empty(spark))) == []


def test_near_chains_and_groups(spark, monkeypatch):
    rng = random.Random(9)
    docs, n = [], 0
    for g in range(4):
        w = [f"g{g}w{rng.randrange(9999)}" for _ in range(120)]
        for _ in range(25):
            docs.append((n, " ".join(w)))
            n += 1
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(len(w))] = f"e{n}"
    rng.shuffle(docs)
    want = plain_near(docs)
    assert len({r[2] for r in want}) < len(docs)
    for rounds in (0, 3):
        monkeypatch.setattr(near_dedup, "HUB_PAIRS", 1000 if rounds else 3)
        assert rows(near_dedup.near_duplicates(documents(spark, docs), star_rounds=rounds)) == want


def test_components(spark):
    edges = [(f"n{i:03d}".encode(), f"n{i + 1:03d}".encode()) for i in range(40)] + [(b"x", b"y"), (b"y", b"x"), (b"z", b"z")]
    got = {bytes(r.node): bytes(r.root) for r in near_dedup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {f"n{i:03d}".encode(): b"n000" for i in range(41)} | {b"x": b"x", b"y": b"x"}


# ---------------------------------------------------------------- op7


def test_exact(spark):
    groups = collections.defaultdict(list)
    for d, t in texts():
        groups[lower_ascii(t)].append(d)
    want = []
    for d, t in texts():
        g = groups[lower_ascii(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((d, keep, len(g), d == keep, sha(lower_ascii(t))))
    assert rows(exact_dedup.exact_dedup(documents(spark))) == sorted(want, key=repr)
    assert rows(exact_dedup.exact_dedup(empty(spark))) == []


# ---------------------------------------------------------------- op8


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.language_ids(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [(truth[r.doc_id], r.lang_pred) for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(a == b for a, b in held) / len(held) >= 0.9 and all(0 <= r.score <= 1 for r in got)


def plain_network(model, window):
    """Probabilities of one window by plain loops."""
    v = [model.embed[b].tolist() for b in window]
    top = []
    for f in range(model.filters.shape[1]):
        weights = model.filters[:, f].tolist()
        values = []
        for p in range(langid.LENGTH - 3):
            flat = [x for j in range(4) for x in v[p + j]]
            values.append(sum(a * b for a, b in zip(flat, weights)))
        top.append(max(0.0, max(values) + float(model.bias[f])))
    z = [sum(t * float(model.out[f, k]) for f, t in enumerate(top)) + float(model.out_bias[k]) for k in range(len(model.languages))]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_network_against_plain_loops(monkeypatch):
    """Windows, their weights and the convolution; texts cut into pieces give the same."""
    model = langid.train(["abc def"] * 8 + ["xyz uvw"] * 8 + ["klm nop"] * 8, ["a"] * 8 + ["b"] * 8 + ["c"] * 8, epochs=2, least_steps=20)
    some = ["abc xyz " * 40, "UVW \u00e9", "12", None, "", "klm " * 200, "abc"]
    want = []
    for t in some:
        if not t or not any(c.isalpha() for c in t):
            want.append(("und", 0.0))
            continue
        raw = t.lower().encode()
        parts = [raw[a : a + 256] for a in range(0, len(raw), 256)]
        p = [sum(len(w) * x for w, x in zip(parts, column)) / len(raw) for column in zip(*(plain_network(model, w.ljust(256, b"\0")) for w in parts))]
        want.append((model.languages[p.index(max(p))], max(p)))
    for piece in (langid.PIECE, 256):
        monkeypatch.setattr(langid, "PIECE", piece)
        lang, score = langid.classify(some, model)
        assert lang == [w for w, _ in want] and np.allclose(score, [s for _, s in want], atol=1e-4)


def test_training_rows_come_from_labelled_ones(spark, monkeypatch):
    assert langid.quotas({"a": 3, "b": 100, "c": 50}, 60) == {"a": 3, "c": 28, "b": 29} and langid.quotas({}, 5) == {}
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.append((texts, langs)))
    docs = [(k, f"text number {k}", "en" if k % 1300 == 0 else None) for k in range(21_000)] + [(5, "same row", "de"), (5, "same row", "de")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    usable = [lang for k, _, lang in docs if lang and zlib.crc32(str(k).encode()) % 4 != 2]
    langid.fit(df)
    assert sorted(seen[0][1]) == sorted(usable)


def test_language_edges(spark):
    got = {r.doc_id: r for r in langid.language_ids(documents(spark, [(1, "hello there"), (2, None), (3, "12 34!"), (4, ""), (5, "ein Satz")])).collect()}
    assert [got[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and got[1].lang_pred in ("en", "de")
    assert langid.language_ids(empty(spark)).count() == 0
    kept = langid.keep_identified(documents(spark, [(1, "hello there"), (2, None), (3, "12 34!"), (5, "ein Satz")]))
    assert {r.doc_id for r in kept.collect()} == {1, 5} and kept.columns == documents(spark).columns
    model = langid.train(["abc def"] * 8 + ["xyz uvw"] * 8, ["a"] * 8 + ["b"] * 8, epochs=20)
    p = model.probabilities(np.frombuffer(b"abc def".ljust(256, b"\0") + b"xyz uvw".ljust(256, b"\0"), np.uint8).reshape(2, 256))
    assert p.argmax(axis=1).tolist() == [0, 1]


# ---------------------------------------------------------------- op9


def test_feistel_is_a_permutation():
    f, g = pii.Feistel(b"k"), pii.Feistel(b"k", decrypt=True)
    for n in (1, 2, 10, 97, 1000):
        image = [f(x, n, "t") for x in range(n)]
        assert sorted(image) == list(range(n)) and [g(y, n, "t") for y in image] == list(range(n))
    assert [f(x, 1000, "t") for x in range(9)] != [pii.Feistel(b"other")(x, 1000, "t") for x in range(9)]


PRIVATE = {"email": "Ann.Lee9@mail.example.com", "phone": "+1 (499) 555-6503", "card": "4539 1488 0343 6467", "ip": "169.122.221.182", "date": "1987-02-28", "iban": "GB82 WEST 1234 5698 7654 32", "ssn": "123-45-6789"}


@pytest.mark.parametrize("kind", sorted(PRIVATE))
def test_pseudonyms(kind):
    value, f = PRIVATE[kind], pii.Feistel(b"k")
    text = f"say {value}, twice {value}."
    new, count = pii.replace(text, f)
    assert count[kind] == 2 and sum(count.values()) == 2 and value not in new
    a, b = new[4:].split(", twice ")
    assert a == b[:-1] and pii.replace(a, f)[1][kind] == 1
    if kind not in ("ip",):
        assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", a))) == re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value)))
    assert pii.replace(new, pii.Feistel(b"k", decrypt=True))[0] == text


def test_what_is_not_private():
    text = "order 4539148803436468 at 300.1.1.1 v1.2.3 on 2023-02-30 or 99-99 x@y 12345 1234567890123456789012 a@b"
    assert pii.replace(text, pii.Feistel(b"k"))[0] == text


BESIDE = {
    "room B12 555-123-4567": "555-123-4567", "Q3 2024-05-06": "2024-05-06", "v2 4111 1111 1111 1111": "4111 1111 1111 1111",
    "2024-05-06 4111 1111 1111 1111": "4111 1111 1111 1111", "2024 4111 1111 1111 1111": "4111 1111 1111 1111", "4111 1111 1111 1111 2024": "4111 1111 1111 1111",
    "4111 1111 1111 1111 12/2027": "4111 1111 1111 1111", "+1 499 555 6503 2024-05-06": "+1 499 555 6503",
}


@pytest.mark.parametrize("text", sorted(BESIDE))
def test_values_beside_other_digits(text):
    value, f = BESIDE[text], pii.Feistel(b"k")
    spans = [text[a:b] for a, b, _, _ in pii.find(text, f)]
    assert value in spans and value not in pii.replace(text, f)[0]
    assert set(spans) <= {value, "2024-05-06"} and ("2024-05-06" in text) == ("2024-05-06" in spans)


DATES = ["3/7/2021", "12/25/1999", "25/12/1999", "3/17/2021", "03/7/2021", "30.1.2001", "1.2.2003", "01.02.2003", "12.25.1999", "2020/02/29", "29.2.2000", "31/1/1950"]


@pytest.mark.parametrize("date", DATES)
def test_dates_keep_their_shape(date):
    for key in (b"a", b"b", b"c", b"d", b"e", b"f"):
        new, count = pii.replace(f"on {date}, so", pii.Feistel(key))
        assert count["date"] == 1 and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", f"on {date}, so")
        assert pii.replace(new, pii.Feistel(key, decrypt=True))[0] == f"on {date}, so"
    assert len({pii.replace(date, pii.Feistel(bytes([k])))[0] for k in range(30)}) > 20


def test_date_permutation():
    """A shape's dates are permuted among themselves."""
    f, some = pii.Feistel(b"k"), pii._dates("1", "1", 1)
    assert len(some) == 200 * 81 and len({f(n, len(some), "x") for n in range(len(some))}) == len(some)


def test_finder_on_random_text():
    """Planted values are found whole between random words, and their text comes back."""
    rng, f, g = random.Random(3), pii.Feistel(b"k"), pii.Feistel(b"k", decrypt=True)
    noise = ["v1.2", "x7", "A-9", "12", "3,5", "(a)", "no.", "1/2", "q@", "2:30", "\u00e9t\u00e9", "\U0001f600", "99%", "#4", "www"]
    values = [*PRIVATE.values(), *DATES, "bob_smith+x@a-b.co.uk", "555-123-4567", "4111111111111111", "10.0.0.1", "DE89370400440532013000"]
    for _ in range(400):
        planted = [rng.choice(values) for _ in range(rng.randrange(1, 5))]
        text, want = "", []
        for v in planted:
            text += " ".join(rng.choice(noise) for _ in range(rng.randrange(1, 6))) + " is "
            want.append((len(text), len(text) + len(v)))
            text += v + " and "
        assert [(a, b) for a, b, _, _ in pii.find(text, f)] == want, text
        new = pii.replace(text, f)[0]
        assert all(v not in new for v in planted) and pii.replace(new, g)[0] == text


def test_long_logs_take_linear_time():
    import time

    def seconds(n):
        began = time.process_time()
        text = " ".join(f"2024-05-{k % 28 + 1:02d} a{k}@x.org 10.0.{k % 256}.7" for k in range(n))
        assert len(list(pii.find(text, pii.Feistel(b"k")))) == 3 * n
        return time.process_time() - began

    seconds(500)
    assert seconds(8000) < 16 * max(0.02, seconds(1000))


def test_pii_in_spark(spark):
    some = [(1, "mail ann.lee@example.com now"), (2, None), (3, ""), (4, "plain"), (5, "x ann.lee@example.com"), (6, long_text() + " 10.1.2.3"), (7, "twice 10.1.2.3"), (7, "twice 10.1.2.3")]
    docs = documents(spark, some)
    assert [tuple(r[:2]) for r in rows(pii.pii_report(docs))] == sorted(((d, t and pii.replace(t, pii.Feistel(b"tidemark"))[0]) for d, t in some), key=repr)
    got = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    assert got[2].text is None and got[3].text == "" and got[4].text == "plain" and got[1].n_email == 1
    assert got[1].text.split()[1] == got[5].text.split()[1] != "ann.lee@example.com"
    assert pii.pseudonymise(docs).columns == docs.columns and pii.pii_report(empty(spark)).count() == 0


# ---------------------------------------------------------------- op10


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        above, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != d)))
    return min(row)


def test_myers():
    rng = random.Random(4)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 40)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(60)))
        d, got = plain_distance(item, text), decontam.myers(item, text, len(item))
        assert (got[0] if got else None) == (d if text else None)


def test_spans_keep_the_budget():
    """Whatever at most k edits do, some piece stays and all spans above it keep theirs."""
    rng = random.Random(6)
    for _ in range(200):
        item = " " + "".join(rng.choice("abcde ") for _ in range(rng.randrange(8, 90))) + " "
        k = len(item) // 10
        cuts = decontam.pieces(item, k)
        assert "".join(p for _, p in cuts) == item and len(cuts) == k + 1
        edits = [rng.randrange(len(item)) for _ in range(rng.randrange(k + 1))]
        holds = lambda a, b: sum(a <= x < b for x in edits)
        assert any(not holds(a, a + len(p)) and all(holds(x, y) <= e for x, y, e in decontam.spans(a, len(item), k)) for a, p in cuts)


def test_large_benchmarks_fit():
    """A 50,000-character item with edits, and the index of one block of 800-character items."""
    import tracemalloc

    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    long = decontam.normalise(make(50_000))
    edited = list(long)
    for p in rng.sample(range(1, len(long) - 1), 300):
        edited[p] = "z"
    tracemalloc.start()
    index = decontam.Index([long], 0.1)
    assert index.find(decontam.normalise("before " + "".join(edited) + " after")) == {0: 300}
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    items = [decontam.normalise(make(800)) for _ in range(2500)]
    tracemalloc.start()
    index = decontam.Index(items, 0.1)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert index.find(items[7] + make(100)).keys() == {7}


def test_short_items_are_whole_words(spark):
    bench = spark.createDataFrame([(1, "cat"), (2, " , ")], "item_id long, text string")
    got = decontam.contaminated(documents(spark, [(1, "a CAT!"), (2, "concatenate"), (1, "cat"), (None, "cat")]), bench)
    assert rows(got) == sorted([(1, 1, 0, 0), (1, 1, 0, 0), (None, 1, 0, 0)], key=repr)


def test_decontamination(spark):
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    items = [(k, make(25)) for k in range(12)] + [(50, None), (51, ""), (7, make(25)), (None, make(25))]
    docs = [(100, make(200)), (101, None), (102, ""), (103, long_text())]
    for k in range(40):
        text = list(items[k % 12][1])
        for _ in range(rng.randrange(0, 24)):
            p = rng.randrange(len(text))
            text[p : p + 1] = rng.choice([[], ["z"], ["y", "x"]])
        shown = "".join(text)
        docs.append((k, f"{make(30)}\n{shown.upper().replace(' ', '!!  ') if k % 3 == 0 else shown} {make(20)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        for i, item in items:
            a, b = decontam.normalise(item), decontam.normalise(t)
            if a and b:
                k = int(0.1 * (len(a) - 2))
                distance = plain_distance(a, b)
                if distance <= k:
                    want.add((d, i, distance))
    best = {}
    for d, i, x in want:
        best[d, i] = min(x, best.get((d, i), x))
    for block in (20_000, 3):
        got = decontam.contaminated(documents(spark, docs), bench, error_rate=0.1, block_items=block)
        assert {(r.doc_id, r.item_id): r.distance for r in got.collect()} == best
    assert 20 < len(best) < 50
    assert decontam.contaminated(empty(spark), bench).count() == decontam.contaminated(documents(spark, docs), bench.limit(0)).count() == 0
