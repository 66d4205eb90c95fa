"""The ten operators against brute force on small tables, edge cases included."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import chat, exact_dedup, huffman, kneser_ney, mixing, packing, quality_rules, simhash, store, substring_dedup, suffix_dedup, token_files, tokens
from quern.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"shared{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "The cat sat. " + PASSAGE + " the end."),
    (2, "Another start " + PASSAGE + " another end"),
    (3, None),
    (4, ""),
    (5, "  \t\n "),
    (6, "short text"),
    (7, "SHORT text"),
    (8, LONG),
    (9, LONG + " " + PASSAGE),
    (10, "a " * 500),
    (11, "line one\n" * 40),
    (12, "The cat sat. " + PASSAGE + " the end."),
    (13, "Ünïcode wörds ärger ß\x1f\x85 é " * 30),
    (14, "".join(chr(97 + i * i % 26) for i in range(900))),
    (15, "x" + "".join(chr(97 + i * i % 26) for i in range(850))),
]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, tid int, ident int, slot int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 0, "b", 1, 2, 3) for i, t in rows], EXTRA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def by_id(df):
    return {x.doc_id: x for x in df.collect()}


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_token_files(spark, docs, none):
    path = tokenizer_file("word_bpe_49k.json")
    found = by_id(token_files.token_files(docs, path))
    library, at = Tokenizer.from_file(path), 0
    for i, text in TEXTS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_files(none, path).count() == 0
    odd = by_id(token_files.token_files(table(spark, [(None, "b"), (2, "a"), (2, "a"), (-3, "c")]), path))
    assert odd[None].start == 0 and odd[-3].start == odd[None].n_tokens and odd[2].start >= odd[-3].start + odd[-3].n_tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=600), st.lists(st.integers(1, 300), min_size=1, max_size=8))
def test_huffman_round_trip(ids, cuts):
    ids = np.array(ids)
    ends = np.unique(np.append(np.minimum(np.cumsum(cuts), len(ids)), len(ids)))
    lengths = huffman.code_lengths(np.bincount(ids) ** 3, limit=9)
    assert lengths.max() <= 9 and sum(2.0 ** -float(n) for n in lengths if n) <= 1
    data, first, marks = huffman.encode(ids, ends, lengths, huffman.canonical(lengths))
    n = np.diff(np.append(0, ends))
    at, size = [], []
    k = 0
    for d, count in enumerate(n):
        for j in range(-(-count // huffman.STEP)):
            at.append(first[d] * 8 + marks[k])
            size.append(min(huffman.STEP, count - j * huffman.STEP))
            k += 1
    assert huffman.Decoder(lengths).decode(data, np.array(at), np.array(size)).tolist() == ids.tolist()


def test_huffman_is_best():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 0, 21])
    assert huffman.code_lengths(counts).tolist() == [7, 7, 6, 5, 4, 3, 2, 0, 1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abzAÉé ßøΣσİ'  \n\n\t .,!<|>#09日́\xa0 \x1f")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_tokens_are_the_library_s(text):
    for name, space in (("word_bpe_49k.json", "none"), ("byte_bpe_50k.json", "before")):
        code = tokens.encoder(tokenizer_file(name), space)
        assert code.encode(text) == code.whole(text)


def test_tokens_of_every_letter_beside_marks():
    for name, space in (("word_bpe_49k.json", "none"), ("byte_bpe_50k.json", "before")):
        code = tokens.encoder(tokenizer_file(name), space)
        chars = [chr(c) for c in range(33, 0x3000)] + [chr(c) for c in range(0x3000, 0x110000) if len(chr(c).lower()) > 1]
        for c in chars:
            for text in (f"a{c}.", f",{c}b a{c}", f"{c}! {c}"):
                assert code.encode(text) == code.whole(text), (name, text)


def events(spark, rows):
    return spark.createDataFrame(rows, "conv long, seq long, kind string, msg long, role string, text string")


def test_chat_folds_events(spark):
    log = [(1, 1, "message", 1, "user", "Hi"), (1, 2, "message", 2, "assistant", "He"), (1, 3, "delta", 2, None, "llo"), (1, 4, "message", 3, "user", "More"), (1, 5, "regenerate", 2, None, "Good "), (1, 6, "delta", 2, None, "day"), (1, 7, "edit", 1, None, "Hey"), (1, 8, "message", 3, "user", "Bye"), (None, 1, "message", 1, None, None)]
    found = sorted(map(tuple, chat.fold(events(spark, log)).collect()), key=str)
    assert found == sorted([(1, 1, "user", "Hey"), (1, 2, "assistant", "Good day"), (1, 3, "user", "Bye"), (None, 1, "", "")], key=str)
    assert chat.fold(events(spark, [])).count() == 0


def test_chat_folds_random_logs(spark):
    rng = np.random.default_rng(12)
    log, want = [], {}
    for conv in range(40):
        said, roles = {}, {}
        for seq in range(60):
            msg, kind = int(rng.integers(1, 7)), ["message", "delta", "edit", "regenerate"][rng.integers(4)]
            role = ["user", "assistant", None][rng.integers(3)] if kind == "message" else None
            log.append((conv, seq, kind, msg, role, f"{seq}."))
            roles[msg] = role or roles.get(msg)
            if kind == "regenerate":
                said = {m: t for m, t in said.items() if m <= msg}
            said[msg] = said.get(msg, "") + f"{seq}." if kind == "delta" else f"{seq}."
        want |= {(conv, m): (roles[m] or "", t) for m, t in said.items()}
    found = chat.fold(events(spark, log))
    assert {(x.conv, x.msg): (x.role, x.text) for x in found.collect()} == want
    assert chat.fold(events(spark, log))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_chat_log_of_turns(spark):
    rows = [(c, i, "assistant" if i % 2 else "user", f"text {c} {i} é" * (i % 5)) for c in range(30) for i in range(7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.turn_log(df)
    assert {x.kind for x in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert sorted(map(tuple, chat.fold(log).collect())) == [(c, i + 1, r, t) for c, i, r, t in rows]


def test_chat_round_trip(spark):
    hostile = ["<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|", "a\\n\nb\\\\n", "<", "", None, "é\n<|im_end|>\n"]
    rows = [(c, i, r, t, 7) for c in (1, 2) for i, t in enumerate(hostile) for r in ("user", "assistant", "odd\nrole\\n<|")] + [(3, None, None, None, 7)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    rendered = chat.render(chat.fold(chat.turn_log(df)))
    found = {x.conv_id: x for x in chat.conversation_digests(rendered).collect()}
    for c in (1, 2, 3):
        own = sorted(((i if i is not None else -1), r or "", t or "") for d, i, r, t, _ in rows if d == c)
        assert found[c].n_turns == len(own)
        assert found[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in own))
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), sha(loss))


def test_exact_dedup(spark, docs, none):
    for rows in (TEXTS, [*TEXTS, (None, "short text"), (None, "only"), (20, "Ä"), (21, "ä"), *[(100 + i, "Copy") for i in range(300)]]):
        df = docs if rows is TEXTS else table(spark, rows)
        groups = defaultdict(list)
        for i, t in rows:
            groups[(t or "").encode().lower()].append(i)
        want = sorted((str(i), str(max([x for x in g if x is not None], default=None)), len(g), i == max([x for x in g if x is not None], default=None), sha(k)) for k, g in groups.items() for i in g)
        assert sorted((str(x[0]), str(x[1]), *x[2:]) for x in exact_dedup.exact_dedup(df).collect()) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def brute_substring(rows, n=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if key in seen:
                gone[s : s + n] = [True] * n
            seen.add(key)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def brute_suffix(rows, n=400):
    count = defaultdict(int)
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for s in range(len(b) - n + 1):
            count[b[s : s + n]] += 1
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if count[b[s : s + n]] > 1:
                gone[s : s + n] = b"\1" * n
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def test_substring_dedup(spark, docs, none):
    found = {x.doc_id: tuple(x)[1:] for x in substring_dedup.substring_dedup(docs).collect()}
    assert found == brute_substring(TEXTS)
    assert substring_dedup.substring_dedup(none).count() == 0
    twice = substring_dedup.substring_dedup(table(spark, [(1, PASSAGE), (1, PASSAGE), (None, PASSAGE)]))
    assert sorted((x.doc_id or 0, x.n_removed) for x in twice.collect()) == [(0, 60), (1, 0), (1, 0)]


def test_suffix_dedup(spark, docs, none):
    found = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.suffix_dedup(docs).collect()}
    assert found == brute_suffix([(i, t) for i, t in TEXTS])
    assert suffix_dedup.suffix_dedup(none).count() == 0
    twice = suffix_dedup.suffix_dedup(table(spark, [(1, "q" * 400), (1, "q" * 400), (None, "r" * 399)]))
    assert sorted((x.doc_id or 0, x.n_removed) for x in twice.collect()) == [(0, 0), (1, 400), (1, 400)]


def test_repeats_in_random_texts(spark):
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("ab c"), 700)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [pool[rng.integers(6)][a : a + rng.integers(100, 700)] for a in rng.integers(0, 300, 4)]
        rows.append((i, "".join(p if rng.random() < 0.7 else p[::-1] for p in parts)))
    df = table(spark, rows)
    assert {x.doc_id: tuple(x)[1:] for x in substring_dedup.substring_dedup(df).collect()} == brute_substring(rows)
    assert {x.doc_id: tuple(x)[1:] for x in suffix_dedup.suffix_dedup(df).collect()} == brute_suffix(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=4))
def test_longest_repeats(texts):
    arrays = [np.array(t, np.uint64) for t in texts]
    ends = np.cumsum([len(t) for t in texts])
    found = quality_rules.longest_repeats(np.concatenate(arrays), np.append(0, ends[:-1]), ends).tolist()
    want = []
    for t in texts:
        for i in range(len(t)):
            best = 0
            for j in range(len(t)):
                k = 0
                while i != j and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
    assert found == want


def test_quality_rules(docs, none):
    found = by_id(quality_rules.quality_rules(docs))
    for i, t in TEXTS:
        w = WORD.findall(t or "")
        count = defaultdict(list)
        for k in range(len(w) - 2):
            count[tuple(w[k : k + 3])].append(k)
        three = {p for at in count.values() if len(at) > 1 for k in at for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        x = found[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(three))
        assert x.base_failed == (len(w) < 50 or 100 * len(three) > 50 * len(w))
    assert found[1].kept and not found[10].kept and not found[3].kept
    assert quality_rules.quality_rules(none).count() == 0


def test_kneser_ney(spark, docs, none):
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice(["the", "river", "runs", "slowly", "over", "stones", "and", "moss"], 80)) for _ in range(200)]
    junk = ["".join(chr(c) for c in rng.integers(33, 127, 400)) for _ in range(50)]
    df = table(spark, [*enumerate(clean), *enumerate(junk, 200), (300, None), (None, clean[0])])
    found = by_id(kneser_ney.classify(df, spark.range(0, 100).select("id").withColumnRenamed("id", "doc_id")))
    assert sum(found[i].kept for i in range(100, 200)) >= 97  # held out
    assert sum(found[i].kept for i in range(200, 250)) == 0
    assert not found[300].kept and found[None].kept
    assert kneser_ney.classify(none, spark.range(0).withColumnRenamed("id", "doc_id")).count() == 0
    assert set(found) == {*range(250), 300, None}


def test_kneser_ney_has_one_threshold_rule(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "train", lambda trusted: None)
    monkeypatch.setattr(kneser_ney, "score", lambda docs, model: docs.select("doc_id", "lang", F.col("text").cast("double").alias("perplexity")))

    def thresholds(**sizes):
        rows = [(lang, math.exp(5 + k / n)) for lang, n in sizes.items() for k in range(n)]
        df = spark.createDataFrame([(i, repr(p), lang) for i, (lang, p) in enumerate(rows)], "doc_id long, text string, lang string")
        found = kneser_ney.classify(df, df.select("doc_id"), held_out=1).collect()
        assert all(x.kept == (x.perplexity <= x.threshold) for x in found)
        return {x.lang: x.threshold for x in found}

    few, many = thresholds(en=199), thresholds(en=201)
    assert abs(few["en"] / many["en"] - 1) < 0.01
    both = thresholds(en=1000, rare=30)
    assert abs(both["rare"] / both["en"] - 1) < 0.3


def brute_kneser_ney(trusted, texts):
    """Perplexities by dictionaries of words, which are known by 20 bits, straight from the definition."""

    def split(text):
        words = [max(1, xxhash.xxh64_intdigest(w.lower()) >> 44) for w in (text or "").encode().split()]
        return [None, *words, None] if words else []

    pairs = Counter(p for t in trusted for w in [split(t)] for p in zip(w, w[1:], strict=False))
    before = Counter(b for _, b in pairs)
    total, kinds = Counter(), defaultdict(list)
    for (a, _), n in pairs.items():
        total[a] += n
        kinds[a].append(n)

    def discounts(counts):
        n = Counter(counts)
        ratio = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = {k: min(k, max(0.1, k - (k + 1) * ratio * n[k + 1] / n[k])) if n[k] else 0.5 for k in (1, 2, 3)}
        return lambda x: min(d[min(x, 3)], min(x, 3) - 0.05)

    high, low = discounts(pairs.values()), discounts(before.values())
    types = sum(before.values())
    unseen = sum(map(low, before.values())) / types / (len(before) + 1)

    def p(a, b):
        below = (before[b] - low(before[b])) / types + unseen if b in before else unseen
        if a not in total:
            return below
        own = max(0, pairs[a, b] - high(pairs[a, b])) / total[a] if (a, b) in pairs else 0
        return own + sum(map(high, kinds[a])) / total[a] * below

    assert abs(sum(p(None, b) for b in before) + p(None, "never seen") - 1) < 1e-9  # a distribution
    out = []
    for t in texts:
        w = split(t)
        logs = [math.log(p(a, b)) for a, b in zip(w, w[1:], strict=False)]
        out.append(math.exp(-sum(logs) / len(logs)) if logs else None)
    return out


def test_kneser_ney_brute(spark, docs, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BLOCK", 300)  # many blocks
    rng = np.random.default_rng(8)
    trusted = [" ".join(rng.choice(60, 50 + i % 7).astype(str)) for i in range(30)] + [t for _, t in TEXTS[:9]]
    texts = [t for _, t in TEXTS] + [" ".join(rng.choice(90, 40).astype(str)) for _ in range(30)] + trusted
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in trusted], "text string").repartition(3))
    rows = spark.createDataFrame([(i, None, t or "") for i, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(3)
    found = {r.doc_id: r.perplexity for r in kneser_ney.score(rows, model).collect()}
    assert len(found) == len(texts)
    for i, want in enumerate(brute_kneser_ney(trusted, texts)):
        assert found[i] is None if want is None else math.isclose(found[i], want, rel_tol=1e-4)


def test_kneser_ney_model_grows(spark):
    rng = np.random.default_rng(9)
    texts = [(" ".join(rng.choice(5000, 300).astype(str)),) for _ in range(80)]
    small, large = (kneser_ney.train(spark.createDataFrame(texts[:n], "text string")).grams.agg(F.sum("n_grams")).first()[0] for n in (20, 80))
    assert large > 3 * small


def test_kneser_ney_takes_all_trusted_texts(spark, monkeypatch):
    rng = np.random.default_rng(10)
    df = table(spark, [(i, " ".join(rng.choice(50, 60).astype(str))) for i in range(120)])
    trusted, read = spark.range(0, 100).withColumnRenamed("id", "doc_id"), []
    train = kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda *parts: read.append([p.count() for p in parts]) or train(*parts))
    whole = by_id(kneser_ney.classify(df, trusted))
    monkeypatch.setattr(kneser_ney, "ROUND", 20)
    assert by_id(kneser_ney.classify(df, trusted)) == whole
    assert len(read[0]) == 1 and len(read[1]) >= 4 and sum(read[0]) == sum(read[1]) > 60


def test_packed_counts():
    key = np.array([2, 5, 5, 1 << 61], np.int64)
    back = kneser_ney.unpack(kneser_ney.pack(key, np.arange(4), np.array([1, 300, 7, 1 << 30])), 2)
    assert [x.tolist() for x in back] == [key.tolist(), [0, 1, 2, 3], [1, 300, 7, 1 << 30]]


@pytest.mark.parametrize("bits", range(simhash.MAX_BITS + 1))
def test_golay_keys_meet(bits):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, bits, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    one, two = (set(zip(*(x.tolist() for x in simhash.keys_of(p)), strict=True)) for p in (a, b))
    assert {i for _, i in one & two} == set(range(len(a)))


def test_simhash(spark, none):
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice(200, 150).astype(str)) for _ in range(10)]
    rows = [*TEXTS, *[(100 + i, re.sub(r"\b7\b", "8", base[i % 10], count=i // 10)) for i in range(60)]]
    found = by_id(simhash.simhash(table(spark, rows)))
    prints = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower().decode())
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = {i: i for i in prints}
    for _ in range(len(prints)):
        least = {i: min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
    assert {i: (x.fingerprint, x.component_id) for i, x in found.items()} == {i: (f"{prints[i]:016x}", least[i]) for i in prints}
    assert simhash.simhash(none).count() == 0


def near_classes_brute(rows):
    """By id the smallest id reachable over pairs that one of the fingerprints finds and that are similar."""
    made = {i: simhash.sketches((t or "").encode()) for i, t in rows}
    sets = {i: set(simhash.shingles((t or "").encode(), 5).tolist()) for i, t in rows}
    wide = {i: simhash.wide_sketch(simhash.shingles((t or "").encode(), 5)) for i, t in rows}

    def near(i, j):
        bits = [(a ^ b).bit_count() for a, b in zip(made[i], made[j], strict=True)]
        far = sum((a ^ b).bit_count() for a, b in zip(wide[i], wide[j], strict=True))
        return min(bits[:-1]) <= simhash.MAX_BITS and bits[-1] <= simhash.SKETCH_BITS and far <= simhash.WIDE_BITS and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])

    links = {i: [j for j in sets if near(i, j)] for i in sets}
    least = {i: i for i in sets}
    for _ in range(20):
        least = {i: min(least[j] for j in links[i]) for i in sets}
    return least


def test_near_dedup(spark, none):
    rng = np.random.default_rng(8)
    base = [rng.choice(500, 200).astype(str).tolist() for _ in range(12)]
    rows = []
    for i in range(48):
        words = list(base[i % 12])
        for at in rng.choice(200, i // 12 * 2, replace=False):
            words[at] = f"new{i}x{at}"
        rows.append((i, " ".join(words)))
    swapped = rows[0][1].split()
    rows += [(100, " ".join(swapped[100:] + swapped[:100])), (101, " ".join(sorted(swapped))), (102, LONG)]  # the same words
    least = near_classes_brute(rows)
    assert len(set(least.values())) < 35 and least[100] == 0 and least[101] == 101
    more = [*rows, (None, rows[0][1]), (7, rows[7][1]), (7, "the same id"), (None, "no id"), (None, None), (None, "")]
    df = table(spark, more)
    found = simhash.near_dedup(df)
    assert found.schema == df.schema
    want = [(i, t) for i, t in rows if least[i] == i] + [(7, "the same id"), (None, "no id")]
    kept = [(x.doc_id, x.text) for x in found.collect()]
    assert sorted(map(str, [x for x in kept if x[1]])) == sorted(map(str, want))
    assert len([x for x in kept if not x[1]]) == 1
    assert simhash.near_dedup(none).count() == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 100_000])
def test_near_dedup_compares_all_of_a_large_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in range(600)]
    rows = []
    for i in range(260):
        words = list(base)
        for at in rng.choice(600, rng.integers(4, 16), replace=False):
            words[at] = f"new{i}x{at}"
        rows.append((i, " ".join(words)))
    least = near_classes_brute(rows)
    assert 1 < len(set(least.values())) < 260
    assert {x.doc_id for x in simhash.near_dedup(table(spark, rows)).collect()} == set(least.values())


def test_forest_prefers_close_sketches():
    prints, node = np.zeros(40, np.int64), np.arange(40)
    sketch = np.where(node % 2, 2**17 - 1, 0)  # two groups that differ in 17 bits
    links = simhash.forest(prints, 4, node, sketch)
    assert len(links) == 39 and sum((a - b) % 2 for a, b in links) == 1
    assert len(simhash.forest(prints, 4, node, np.where(node % 2, 2**30 - 1, 0))) == 38


def test_forest_links_all():
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(0, 2**12, 300)).astype(np.int64)
    parent = {int(v): int(v) for v in x}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in simhash.forest(x, 1):
        parent[top(a)] = top(b)
    for a in x:
        for b in x:
            if int(a ^ b).bit_count() <= 1:
                assert top(int(a)) == top(int(b))


def test_packing(spark, docs, none):
    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = {}
    for i, text in TEXTS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    rows = packing.pack_documents(docs, path).collect()
    assert {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in rows} == want
    sequences = defaultdict(list)
    for x in rows:
        sequences[x.sequence_id].append((x.offset, x.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    where, offset, _ = packing.best_fit(lengths, packing.Rooms(64), 64, 0)
    room: list[int] = []
    for n, w, o in zip(lengths, where, offset, strict=True):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[w] == min(fits)
        else:
            assert w == len(room)
            room.append(64)
        assert o == 64 - room[w]
        room[w] -= n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=6), st.data())
def test_pfair(parts, data):
    slots, total = mixing.period(parts), sum(parts)
    assert sorted(t for s in slots for t in s) == list(range(total))
    for w, own in zip(parts, slots, strict=True):
        for t in range(total + 1):
            assert abs(sum(x < t for x in own) - w * t / total) < 1
    blocks = data.draw(st.lists(st.integers(0, 80), min_size=len(parts), max_size=len(parts)))
    used = set()
    for n, own in zip(blocks, mixing.phases(blocks, parts), strict=True):
        assert sum(p["n"] for p in own) == n
        for p in own:
            for i in range(p["n"]):
                slot = p["slot"] + i // len(p["slots"]) * p["size"] + p["slots"][i % len(p["slots"])]
                assert slot not in used
                used.add(slot)
    assert used == set(range(sum(blocks)))


def test_mixing(spark, none):
    rows = [(i, None if i % 7 == 0 else "big" if i % 3 else "small") for i in range(2000)] + [(None, "big"), (5, "big"), (5, "big")]
    df = spark.createDataFrame([(i, s, 1) for i, s in rows], "doc_id long, source string, of int")
    weights = {"big": 5, "small": 3, None: 1}
    found = mixing.mix_sources(df, weights, block=4).collect()
    assert sorted(str((x.doc_id, x.source)) for x in found) == sorted(map(str, rows))
    order = sorted({(x.slot, x.source, x.block) for x in found}, key=lambda x: x[0])
    assert [x[0] for x in order] == list(range(len(order)))
    left = {s: sum(r[1] == s for r in rows) for s in weights}
    end = min(i for i, x in enumerate(order) if any(sum(y[1] == s for y in order[: i + 1]) >= -(-left[s] // 4) for s in weights))
    for t in range(end + 1):
        for s, w in weights.items():
            assert abs(sum(x[1] == s for x in order[:t]) - w * t / 9) < 1
    assert mixing.mix_sources(none).count() == 0


def test_mixing_of_many_sources_and_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 4)
    rows = [(i, f"s{i % 3}" if i % 4 else f"tail{i % 50}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    found = mixing.mix_sources(df, block=1).orderBy("slot").collect()
    assert sorted((x.doc_id, x.source) for x in found) == sorted(rows) and [x.slot for x in found] == list(range(1500))
    large = mixing.mix_sources(df, {"s0": 3_000_000_000, "s1": 0}, block=1).orderBy("slot").collect()
    assert sorted((x.doc_id, x.source) for x in large) == sorted(rows)
    assert min(x.slot for x in large if x.source == "s1") > max(x.slot for x in large if x.source == "s0")
    same = spark.createDataFrame([(None, "s", i) for i in range(100)] + [(5, "s", 1)] * 3, "doc_id long, source string, n int")
    assert sorted(x.slot * 16 + x.place for x in mixing.mix_sources(same).collect()) == list(range(103))


def test_in_order(spark, none):
    rows = [(i, f"text {i}", "big" if i % 3 else "small") for i in range(3000)]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, source string, block int, slot int, row int").repartition(5)
    found = mixing.in_order(df)
    assert found.schema == df.schema
    place = {x.doc_id: (x.s, x.p) for x in mixing.mix_sources(df, names=("b", "s", "p")).collect()}
    order = [x.doc_id for x in found.collect()]
    assert order == sorted(place, key=place.get) and mixing.in_order(none).count() == 0


def test_rows_are_judged_by_themselves(spark, docs, none):
    text = " ".join(f"w{i}" for i in range(80))
    df = table(spark, [(1, text), (1, "two words"), (2, text.upper()), (2, text.upper()), (None, None), (None, ""), (None, text + " x")])
    good = quality_rules.keep_good(df)
    assert good.schema == df.schema
    assert sorted(str(x.doc_id) for x in good.collect()) == ["1", "2", "2", "None"] and quality_rules.keep_good(none).count() == 0
    kept = exact_dedup.keep_rows(df)
    assert kept.schema == df.schema
    assert sorted((str(x.doc_id), len(x.text or "")) for x in kept.collect()) == sorted([("2", len(text)), ("1", 9), ("None", 0), ("None", len(text) + 2)])
    assert exact_dedup.keep_rows(none).count() == 0


def test_repetition_verdict(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 400, 100)]
        n = int(rng.integers(5, 25))
        rows.append((i, " ".join(w[:50] + w[10 : 10 + n] + w[50:] + w[:3] * int(rng.integers(0, 3)))))
    found, wrong = by_id(quality_rules.quality_rules(table(spark, rows))), 0
    for i, t in rows:
        w = t.split()
        covered, longest = set(), 0
        for a in range(len(w)):
            best = 0
            for b in range(len(w)):
                k = 0
                while a != b and max(a, b) + k < len(w) and w[a + k] == w[b + k]:
                    k += 1
                best = max(best, k)
            longest = max(longest, best)
            covered |= set(range(a, a + best)) if best >= 10 else set()
        x = found[i]
        assert (x.n_covered, x.longest_repeat) == (len(covered), longest)
        fine = len(covered) <= 0.2 * len(w) and (longest < 10 or longest <= 0.1 * len(w))
        assert x.kept == (fine and not x.base_failed)
        wrong += not fine and not x.base_failed
    assert wrong > 10


def test_clean_deletes_what_was_written(spark, docs):
    base = store.distinct_texts(store.texts_of(docs))
    path = store.new_path(spark, "x")
    docs.write.parquet(path)
    assert base.count() == len({t or "" for _, t in TEXTS})
    store.clean(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quern_")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_no_python_in_mixing(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert store.partitions(docs.sparkSession) > 0
