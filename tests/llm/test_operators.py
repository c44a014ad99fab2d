"""The training-data operators on small fixtures, against brute force and round trips."""

import functools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidepanel.llm import common, ctw, decontaminate, language, matroska, packing, pii, preference, simhash, substring_dedup, toxicity

DOC = "doc_id long, text string, lang string, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in rows], DOC)


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(90)]
    rows = [(0, None), (1, ""), (2, "a b c"), (None, " ".join(passage))]
    for i in range(3, n):
        text = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            cut = rng.randint(0, 40)
            text[at:at] = passage[cut : cut + rng.randint(45, 90)]
        rows.append((i, " \n".join(text)))
    return rows + [rows[10], (rows[12][0], rows[15][1]), (n, rows[9][1]), (n + 1, "x " * 3000)]


def without_repeats(rows, window=50):
    """Brute force: (doc_id, n_words, n_removed, kept text) of every row."""
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").split()
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    expected = []
    for i, t in rows:
        w = (t or "").split()
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                keep[s : s + window] = [False] * window
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        expected.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(expected, key=lambda r: tuple(map(str, r)))


def removed(spark, rows):
    return sorted((tuple(r) for r in substring_dedup.remove_repeats(spark, docs(spark, rows)).collect()), key=lambda r: tuple(map(str, r)))


def test_substring_dedup_is_brute_force(spark):
    rows = corpus()
    assert removed(spark, rows) == without_repeats(rows)


def test_substring_dedup_of_two_words_and_of_long_words(spark):
    # Thue-Morse words cancel in every polynomial hash with an odd base modulo a power of two.
    letters = [("a", "b")[i.bit_count() % 2] for i in range(1024)]
    tail = [f"t{i}" for i in range(49)]
    other = [("b", "a")[i.bit_count() % 2] for i in range(1024)]
    big = ["x" * 5000 + str(i) for i in range(60)]
    rows = [(1, " ".join(letters + tail)), (2, " ".join(other + tail)), (3, " ".join(big)), (4, "a " + " ".join(big)), (5, "z " * 400), (6, "z " * 60), (6, "z " * 60), (7, " ".join(tail + ["one"])), (8, " ".join(["two"] + tail))]
    assert removed(spark, rows) == without_repeats(rows)


def test_substring_dedup_of_an_empty_table_and_clashing_columns(spark):
    assert substring_dedup.remove_repeats(spark, docs(spark, [])).count() == 0
    clash = docs(spark, corpus(30)).withColumns({c: F.lit(1) for c in ("anchor", "words", "start", "spans", "single", "packed", "row_key")})
    assert sorted(map(str, substring_dedup.remove_repeats(spark, clash).collect())) == sorted(map(str, substring_dedup.remove_repeats(spark, docs(spark, corpus(30))).collect()))


def test_unbranched_repeats_become_one_path(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(["x", *words[500:1500], "y"])), (4, " ".join(words[2000:]))]
    spans = substring_dedup.repeated_spans(spark, docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.start, r.n_windows, r.src_doc, r.src_start) for r in spans if r.doc_id == 2 and r.n_windows > 200)[0][1] == 0
    assert len(spans) < 20 + 2 * 62  # not one for each of the 5,000 windows
    assert {r.src_doc for r in spans} == {1}


def test_word_codes_tell_words_apart():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab\u00e9") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["q" * n for n in (2047, 2048, 2049, 9000)]
    data = " ".join(texts).encode()
    raw = np.frombuffer(data, np.uint8)
    words = common.Words(raw, np.array([0, len(raw)]))
    codes = common.word_codes(raw, words)
    assert len(set(codes.tolist())) == len(set(texts)) and len(codes) == len(texts)
    assert all((t == u) == (a == b) for (t, a), (u, b) in zip(zip(texts, codes.tolist(), strict=True), zip(texts[1:], codes[1:].tolist(), strict=False), strict=False))


def test_run_codes_are_those_of_equal_runs():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 3, 500).astype(np.uint64)
    for width, found in zip((1, 5, 20, 49, 50), common.run_codes(codes, 1, 5, 20, 49, 50), strict=True):
        of = {}
        for i, c in enumerate(found.tolist()):
            assert of.setdefault(tuple(codes[i : i + width].tolist()), c) == c
        assert len(found) == 500 - width + 1 and len(set(of.values())) == len(of)
    assert [len(x) for x in common.run_codes(codes[:7], 5, 8)] == [3, 0]


def test_fingerprint_is_the_majority_of_shingle_bits():
    words = "The quick BROWN fox jumps over the lazy dog the quick brown fox".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(" ".join(words).upper().encode()) == expected
    assert simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("split", [1024, 3])
def test_covering_tables_miss_no_link(spark, split):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 12)
    fps = {int(b) for b in base} | {0, -1}
    for b in base[:4]:
        for _ in range(40):
            flips = rng.choice(63, rng.integers(1, 7), replace=False)
            fps.add(int(b) ^ int(sum(1 << int(f) for f in flips)))
    fps = sorted(fps)
    links = simhash.fingerprint_links(spark, spark.createDataFrame([(f,) for f in fps], "fp long"), split=split).collect()

    def groups(pairs):
        root = {f: f for f in fps}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for f in fps:
            out.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, out.values()))

    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
    assert all(near(r.a, r.b) for r in links)
    assert groups([(r.a, r.b) for r in links]) == groups([(a, b) for a in fps for b in fps if a < b and near(a, b)])


def test_near_duplicates_of_edge_rows(spark):
    rows = simhash.near_duplicates(spark, docs(spark, [(5, None), (4, ""), (7, "one two three four five"), (9, "ONE two three four five"), (9, "ONE two three four five"), (None, "zz")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (4, 4), (5, 4), (7, 7), (9, 7), (9, 7)]
    assert simhash.near_duplicates(spark, docs(spark, [])).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_patterns_equal_a_plain_search():
    rng = random.Random(3)
    for _ in range(20000):
        s = "".join(rng.choice("a1.@-2+ .") for _ in range(rng.randint(1, 30)))
        found = pii.base_spans(s)
        assert [x[1:] for x in found if x[0] == "email"] == [m.span() for m in EMAIL.finditer(s)]
        assert [x[1:] for x in found if x[0] == "ip"] == [m.span() for m in IP.finditer(s) if all(int(p) <= 255 for p in m[0].split("."))]


def test_field_adds_what_patterns_miss():
    field = pii.trained()
    text = "é call 555-123-4567 or use password=b7db7aa4a5fcc78305 by 2.0. of 2023-01-02, a.b@c.example.com"
    found = [(k, text[a:b], base) for k, a, b, base in pii.find_spans(text, field)]
    assert ("email", "a.b@c.example.com", True) in found and ("phone", "555-123-4567", False) in found and ("secret", "password=b7db7aa4a5fcc78305", False) in found
    assert len(found) == 3 and pii.find_spans("the plain text of a clean document.", field) == []


def test_field_finds_spans_without_digits():
    field = pii.trained()
    for text, kind, part in (
        ("please use password=correcthorsebattery for it", "secret", "password=correcthorsebattery"),
        ('it has secret = "abcdefghijkl" in it', "secret", 'secret = "abcdefghijkl'),
        ("write to bob AT host DOT org today", "email", "bob AT host DOT org"),
        ("write to bob at host.com today", "email", "bob at host.com"),
    ):
        assert [(k, text[a:b]) for k, a, b, _ in pii.find_spans(text, field)] == [(kind, part)]
    for text in ("we look at home. Then we go", "the password is wrong", "a dot product of two", "he sat at u.s. bases then", "the secret: nobody knows"):
        assert pii.find_spans(text, field) == []


def test_zones_decode_like_the_whole_text():
    field, rng = pii.trained(), random.Random(11)
    for _ in range(40):
        text = " ".join([*rng.choices(["plain", "a", "key", "monkeys", "that.is", "passing", "+x", "..."], k=rng.randint(0, 12)), pii._sentence(rng)[0], *rng.choices(["words", "at", "home"], k=rng.randint(0, 12)), pii._sentence(rng)[0]])
        base = pii.base_spans(text)
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        whole = field.decode(field.segments(text, tokens, {(a, b): k for k, a, b in base}))
        expected = {(pii.TYPES[y - 1], *pii._trim(text, tokens[a][0], tokens[b - 1][1])) for a, b, y, gain in whole if gain >= pii.GAIN}
        expected = {s for s in expected if all(s[2] <= a or b <= s[1] for _, a, b in base)}
        assert {s[:3] for s in pii.find_spans(text, field) if not s[3]} == expected


def test_segmentation_is_the_best_of_all():
    field = pii.trained()
    text = "id 4111 1111 1111 x"
    tokens = [m.span() for m in re.finditer(r"\S+", text)]
    segments = list(field.segments(text, tokens, {}))
    scores = [field.scores(r) for r in segments]

    def best(at, before):
        if at == len(tokens):
            return 0.0
        return max(scores[at + n - 1][n - 1, y] + field.moves[before, y] + best(at + n, y) for n in range(1, min(pii.LONGEST, len(tokens) - at) + 1) for y in range(len(pii.TYPES) + 1))

    def score(marked):
        total, at, before = 0.0, 0, 0
        spans = {a: (b, y) for a, b, y, _ in marked}
        while at < len(tokens):
            end, y = spans.get(at, (at + 1, 0))
            total += scores[end - 1][end - at - 1, y] + field.moves[before, y]
            at, before = end, y
        return total

    assert score(field.decode(segments)) == pytest.approx(best(0, 0))


def test_toxicity_learns_words_and_their_misspellings(spark):
    rng = random.Random(1)
    plain = lambda n: " ".join(rng.choice(["thon", "ered", "blean", "stori", "andou", "hesti"]) + rng.choice("abcde") for _ in range(n))
    rows = [(i, f"{plain(40)} {'you stupid idiot ' if i % 2 else ''}{plain(60)}") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    probe = [(1000, f"{plain(300)} stupidd idiiot {plain(300)}"), (1001, plain(500)), (1002, None), (1003, "")]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark, docs(spark, rows + probe), labels, common.crc_mod("doc_id", 5) != 0).collect()}
    assert got[1000] > 0.5 > got[1001] and got[1002] == got[1003] and len(got) == 204
    assert all((got[i] >= 0.5) == bool(i % 2) for i, _ in rows)
    none = toxicity.score_toxicity(spark, docs(spark, probe), labels.limit(0), common.crc_mod("doc_id", 5) != 0).collect()
    assert {r.score for r in none} == {0.0}


def test_language_by_compression(spark):
    rng = random.Random(2)
    words = {"en": "the and with from that have this".split(), "de": "und der die nicht auf eine ist".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(60)), k, "s") for i in range(60) for k in [("en", "de")[i % 2]]]
    df = spark.createDataFrame([*rows, (100, None, "en", "s"), (101, "12 34 !", "de", "s"), (102, "THE!! AND!! WITH!! FROM!! THAT!! HAVE!! THIS!! AND!!", None, "s")], DOC)
    got = {r.doc_id: r for r in language.identify_language(spark, df, common.crc_mod("doc_id", 4) != 2).collect()}
    assert all(got[i].lang_pred == k for i, _, k, _ in rows) and got[102].lang_pred == "en"
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].score == 0 and got[101].rejected


def test_matroska_round_trip_and_lacing(spark):
    rng = random.Random(5)
    for n in (0, 1, 64, 511, 4096, 5000, 100_000):
        raw = bytes(rng.randrange(256) for _ in range(n))
        media = matroska.mux(matroska.pad(raw))
        found = matroska.parse(media)
        assert b"".join(media[p.offset : p.offset + p.size] for p in found.packets) == matroska.pad(raw)
        assert all(media[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in found.cues)
        for cut in range(0, len(media), max(1, len(media) // 40)):
            matroska.parse(media[:cut])
    frames = [bytes(k) for k in (3, 300, 255, 7)]
    for kind in (1, 3):
        body = matroska._lace(frames, kind)
        assert [s for _, s in matroska._frames(body, 0, len(body), kind << 1)] == [3, 300, 255, 7]
    df = docs(spark, [(1, "abc"), (2, "abc"), (3, None)])
    a, b, e = matroska.store_texts(df).orderBy("doc_id").collect()
    assert a[1:] == b[1:] and e.n_bytes == 0 and e.payload_bytes == 64
    assert matroska.packet_table(matroska.media_column(df)).count() == 3


def test_preference_pairs(spark):
    turns = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, [("user", "q"), ("assistant", "good")], [("user", "q"), ("assistant", "bad"), ("user", "hm")]), (2, [("user", "q")], [("user", "q")]), (3, [], [("assistant", "z")])], f"pair_id long, chosen {turns}, rejected {turns}")
    a, b, d = preference.format_pairs(pairs).orderBy("pair_id").collect()
    assert a.prompt == "<|im_start|>user\nq<|im_end|>\n" and a.n_prompt_turns == 1
    assert [a.rejected[m.start : m.end] for m in a.rejected_mask] == ["bad<|im_end|>\n"] and [a.chosen[m.start : m.end] for m in a.chosen_mask] == ["good<|im_end|>\n"]
    assert b.identical and b.chosen == "" and d.n_prompt_turns == 0 and d.prompt == ""
    rows = [(2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, None, "c"), (3, 1, "assistant", None), (3, 1, "assistant", None), (5, 0, "user", "alone"), (None, 0, "user", "n")]
    made = preference.pairs_from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("pair_id").collect()
    assert [(r.pair_id, r.chosen[-1].text, r.rejected[-1].text) for r in made] == [(2, "b", ""), (3, "", "b")]


@pytest.mark.parametrize("ids", [[0, 2, 4, 6, 8], [7, -5, 1 << 40, (1 << 63) - 1, 12], list(range(100, 1100, 3))])
def test_every_answered_conversation_makes_a_pair(spark, ids):
    rows = [(i, t, r, f"{i} {r}") for i in ids for t, r in enumerate(("user", "assistant"))] + [(3, 0, "user", "no answer")]
    made = preference.pairs_from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    order = sorted(ids)
    assert sorted((r.pair_id, r.chosen[-1].text, r.rejected[-1].text) for r in made) == [(i, f"{i} assistant", f"{n} assistant") for i, n in zip(order, order[1:] + order[:1], strict=True)]


def test_a_single_answered_conversation_makes_no_pair(spark):
    for rows in ([(4, 0, "assistant", "a"), (5, 0, "user", "b")], [(5, 0, "user", "b")]):
        assert preference.pairs_from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 0


def coded(text):
    """(bytes before, newest first, as far as a context reaches; byte) of every byte of a text."""
    words = (text or "").encode().lower().split()
    for i, w in enumerate([*words, b"\n"]):
        before = bytes(3) + words[i - 1] if i else bytes(3)
        yield (32, *before[:-4:-1], 0, 0, 0), w[0]
        if i < len(words):
            whole = bytes(6) + b" " + w + b" "
            for at in range(8, len(whole)):
                yield tuple(whole[at - 1 : at - 8 : -1]), whole[at]


def plain_weighting(train, texts):
    """Context-tree weighting over dictionaries: log10 of the probability of each text."""
    count, longer = {}, {}
    for learn, some in ((1, train), (0, texts)):
        for text in some:
            for context, byte in coded(text):
                for k in range(8):
                    node, bit = byte >> (8 - k) | 1 << k, byte >> (7 - k) & 1
                    for d in range(ctw.DEPTH + 1):
                        count.setdefault((context[:d], node), [0, 0])[bit] += learn
                        if d:
                            longer.setdefault((context[: d - 1], node), set()).add((context[:d], node))

    def own(key):
        n0, n1 = count[key]
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    @functools.cache
    def weighted(key):
        if key not in longer:
            return own(key)
        return np.logaddexp(own(key), sum(map(weighted, sorted(longer[key])))) - math.log(2)

    def one(context, node, d=0):
        n0, n1 = count[context[:d], node]
        kt = (n1 + 0.5) / (n0 + n1 + 1)
        if d == ctw.DEPTH or not sum(count[context[: d + 1], node]):
            return kt
        below = sum(map(weighted, sorted(longer[context[:d], node])))
        share = 1 / (1 + math.exp(below - own((context[:d], node))))
        return share * kt + (1 - share) * one(context, node, d + 1)

    def log(text):
        total = 0
        for context, byte in coded(text):
            for k in range(8):
                p = one(context, byte >> (8 - k) | 1 << k)
                total += math.log10(p if byte >> (7 - k) & 1 else 1 - p)
        return total

    return [log(t) for t in texts]


@pytest.mark.parametrize(("top", "frequent"), [(2, 3), (1 << 18, 1 << 19)])
def test_context_tree_is_plain_weighting_and_base_is_exact(spark, top, frequent):
    texts = ["the cat sat", "The dog sat on 12 mats!", "", None, "\u00e9 \u00f1 \u00df " * 5, "extraordinarily long wordings of extraordinary kinds", "x" * 40]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "the null"), (0, "another row of id zero")]
    got = ctw.score_texts(spark, docs(spark, rows), common.crc_mod("doc_id", 7) != 2, top=top, frequent=frequent).collect()
    train = [(i, t) for i, t in rows if i is not None and common.crc32_text(i) % 7 != 2]
    tokens = lambda t: [w.lower() for w in (t or "").encode().split()] + [None]
    count = {}
    for _, t in train:
        for w in tokens(t):
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    expected = []
    for (i, t), score in zip(rows, plain_weighting([t for _, t in train], [t for _, t in rows]), strict=True):
        base = sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tokens(t))
        expected.append((str(i), len(tokens(t)), sum(w in count for w in tokens(t)), n, round(base, 6), round(score, 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(expected)


def test_context_tree_without_training_or_rows(spark):
    rows = ctw.score_texts(spark, docs(spark, [(1, "ab c")]), F.lit(False)).collect()
    assert rows[0].score == pytest.approx(6 * 8 * np.log10(0.5)) and rows[0].n_known == 0 and rows[0].bits_per_byte == pytest.approx(8)
    assert ctw.score_texts(spark, docs(spark, []), F.lit(True)).count() == 0


def test_leaks_are_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((1, 3, 5, 8, 20, 40, 40))] + [(7, None), (8, "..."), (None, "w1 w2 w3 w4 w5 w6")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(120))) for i in range(20)]
    rows += [(30 + i, f"Foo, bar! {t.upper()}; baz " + "z " * 2000) for i, t in items if t and i is not None] + [(60, " ".join(items[5][1].split()[:35])), (61, None), (62, "")]
    grams = lambda t, k: {tuple(w[p : p + k]) for w in [re.findall(r"[a-z0-9]+", t.lower())] for p in range(len(w) - k + 1)}
    expected = set()
    for i, t in items:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        if i is None or not w:
            continue
        g = grams(t, min(5, len(w)))
        expected |= {(d, i) for d, x in rows if len(g & grams(x or "", min(5, len(w)))) / len(g) >= 0.8}
    found = decontaminate.find_leaks(spark, docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected)


def test_packing_holds_every_token_once(spark):
    rng = random.Random(7)
    sizes = [(i, rng.choice([1, 3, 90, 700, 3000, 20_000])) for i in range(300)] + [(None, 5)]
    got = packing.pack_documents(spark, spark.createDataFrame(sizes, "doc_id long, n_tokens long"), shard=100_000).toPandas()
    assert got.n_tokens.sum() == sum(n for _, n in sizes) and len(got[["doc_id", "piece"]].drop_duplicates()) == len(got)
    by = got.groupby("sequence_id").agg(total=("n_tokens", "sum"), size=("sequence_length", "first"))
    assert (by.total <= by["size"]).all() and all(min(c for c in packing.LENGTHS if c >= t) == s for t, s in zip(by.total, by["size"], strict=True))
    for _, g in got.sort_values("position").groupby("sequence_id"):
        assert (g.position == g.n_tokens.cumsum() - g.n_tokens).all()
    assert packing.pack_documents(spark, spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_packing_opens_the_length_of_least_cost_for_what_is_to_come():
    where, lengths = packing.pack([300] * 39)
    assert where == [i // 13 for i in range(39)] and lengths == [4096] * 3
    # The second sequence takes the piece that the first (opened with 15) expects, and the first is cut down to 14.
    assert packing.pack([8, 8, 5, 4, 2], (11, 14, 15)) == ([0, 1, 1, 0, 0], [14, 14])


def test_language_dictionaries_hold_whole_texts(spark):
    long = "alpha beta gamma delta " * 20000
    rows = [(1, long, "en"), (1, long + "zz", "en"), (2, "uno dos tres cuatro " * 30, "es"), (2, "uno dos tres cuatro " * 30, "es"), (3, long, "es"), (None, "abc", "fr"), (3, None, "de"), (4, "12 34", "nn")]
    rows += [(i, f"un deux trois {'x' * (1 + i % 90)} fin", "fr") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.dictionaries(docs, F.lit(True), size=4096)
    assert set(found) == {"en", "es", "fr"} and len(found["en"]) == 4096 and found["es"].strip() == ("uno dos tres cuatro " * 30).strip().encode()
    texts = found["fr"].split(b"\n")
    assert 4096 - 110 < len(found["fr"]) <= 4096 and set(texts) <= {t.encode() for _, t, k in rows if k == "fr"} and all(t.startswith(b"un ") and t.endswith(b" fin") for t in texts)
    assert len(language.dictionaries(docs, F.lit(True), sample=3, size=4096)["fr"].split(b"\n")) == 3


@pytest.mark.parametrize("id", [1, 2, 3, 77, 12345])
def test_a_language_of_one_id_is_learned(spark, id):
    rows = [(id, f"der hund und die katze {i}", "de") for i in range(3000)] + [(1000 + i, "the dog and the cat", "en") for i in range(3000)]
    found = language.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert set(found) == {"en", "de"} and b"katze" in found["de"]


@pytest.mark.parametrize("length", [300_000, 3_000])
def test_a_long_text_takes_no_class_from_the_sample(spark, length):
    rows = [(i, "you stupid idiot" if i % 2 else "a quiet day") for i in range(60)]
    rows = [(i, "x " * length if i in (7, 8) else t) for i, t in rows]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.training_sample(docs(spark, rows), labels, F.lit(True), chars=100_000)
    assert sum(y for _, y in got) == len(got) // 2 and len(got) == (58 if length > 50_000 else 60)
    alone = toxicity.training_sample(docs(spark, [(7, "x " * length), (8, "y")]), labels, F.lit(True), chars=100_000)
    assert sorted((y, len(t)) for t, y in alone) == [(0, 1), (1, min(2 * length, 100_000))]


def least_cost(sizes, lengths):
    """Brute force: the least total cost of sequences that hold all pieces."""
    best = math.inf

    def place(i, used):
        nonlocal best
        if i == len(sizes):
            best = min(best, sum(packing.cost(next(c for c in lengths if c >= u)) for u in used))
            return
        for b in range(len(used)):
            if used[b] + sizes[i] <= lengths[-1]:
                used[b] += sizes[i]
                place(i + 1, used)
                used[b] -= sizes[i]
        place(i + 1, [*used, sizes[i]])

    place(0, [])
    return best


def test_packing_is_near_the_least_cost_of_all_and_below_single_lengths():
    rng, lengths = random.Random(8), (512, 1024, 2048, 4096)
    total = optimum = single = 0.0
    for _ in range(60):
        sizes = sorted((rng.choice([100, 300, 500, 700, 1100, 1500, 2000]) + rng.randint(0, 90) for _ in range(rng.randint(1, 7))), reverse=True)
        mine = sum(map(packing.cost, packing.pack(sizes, lengths)[1]))
        best = least_cost(sizes, lengths)
        assert best <= mine * (1 + 1e-9) and mine <= 1.5 * best
        total, optimum = total + mine, optimum + best
        single += min(len(packing.pack(sizes, (c,))[1]) * packing.cost(c) for c in lengths if c >= sizes[0])
    assert total < 1.06 * optimum and total < 0.9 * single


def test_packing_deals_rows_that_repeat_over_shards(spark):
    rows = spark.createDataFrame([(None, 700)] * 3000, "doc_id long, n_tokens long")
    got = packing.pack_documents(spark, rows, shard=100_000).toPandas()
    by_shard = got.groupby(got.sequence_id.map(lambda s: s >> 32)).size()
    assert len(got) == 3000 and len(by_shard) == 21 and by_shard.max() < 250


def test_packing_of_texts(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "w " * 9000)]
    got = packing.pack_texts(spark, docs(spark, rows).withColumn("n_tokens", F.lit(1)).withColumn("piece", F.lit("x"))).collect()
    assert sorted((str(r.doc_id), r.piece, r.n_tokens) for r in got) == [("1", 0, 1), ("1", 0, 1), ("2", 0, 1), ("3", 0, 8192), ("3", 1, 809), ("None", 0, 3)]


def test_packing_leads_back_to_the_words_and_does_not_depend_on_partitions(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.choice([0, 3, 400, 900])))) for i in range(60)]
    rows += [(None, "n " * 700), (None, "m " * 20), (5, "again " * 30), (5, rows[5][1]), (7, None), (3_000_000_000_000_000_001, "big id")] + [(8, "same words")] * 30
    df = docs(spark, rows)
    at = [packing.pack_texts(spark, df.repartition(n), (128, 256), 3000).collect() for n in (3, 7)]
    assert sorted(map(str, at[0])) == sorted(map(str, at[1])) and len({r.sequence_id >> 32 for r in at[0]}) > 4
    key = {(r.doc_id, r.key): r.text for r in df.select("doc_id", F.xxhash64("text").alias("key"), "text").collect()}
    pieces = {}
    for r in at[0]:
        pieces.setdefault((r.doc_id, r.text_key, r.copy), []).append(r)
    assert len(pieces) == len(rows) and any(i == 3_000_000_000_000_000_001 for i, _, _ in pieces)
    for (i, k, _), parts in pieces.items():
        words, parts = (key[i, k] or "").split(), sorted(parts, key=lambda r: r.piece)
        assert [w for r in parts for w in words[r.start_word : r.end_word]] == words and sum(r.n_tokens for r in parts) == len(words) + 1
        assert all(r.end_word - r.start_word == r.n_tokens for r in parts[:-1]) and parts[-1].end_word - parts[-1].start_word == parts[-1].n_tokens - 1


def test_packing_of_text_ids(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", "z"), (None, None)], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in packing.pack_texts(spark, df).collect()) == [("None", 1), ("a", 3), ("b", 2)]
