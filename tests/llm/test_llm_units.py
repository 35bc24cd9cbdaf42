"""The operators' parts against brute force, without Spark."""

import collections
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veinstone.llm import chat, decontamination, embedding_dedup, near_dedup, packing, pii, quality, toxicity
from veinstone.llm.shingles import shingle_sets
from veinstone.llm.token_counts import count_by_chunks
from veinstone.llm.tokenizing import piece_encoder, word_encoder

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "it's We'll 12 3á x² é—a<|endoftext|>b <|startoftext|>   Σας ΑΣ İx 　y\x1cz", "a\x85b", "́abc de!?'s <b>", "日本語 テスト 😀😀", "don't,,", "▁a ▁ b  c", " a", "a ", "a\nb\tc"]
text = st.text(st.sampled_from("ab c\n\t.'1é▁😀日<|>"), max_size=200)


def test_tokenizers_on_odd_texts():
    w, p = word_encoder(WORDS), piece_encoder(PIECES)
    assert w.ids_bytes(ODD) == [w.whole(x) for x in ODD]
    assert p.counts(ODD) == [p.count(x) for x in ODD]


@settings(max_examples=150, deadline=None)
@given(text)
def test_tokenizers_on_any_text(x):
    w, p = word_encoder(WORDS), piece_encoder(PIECES)
    assert w.ids_bytes([x])[0] == w.whole(x)
    assert p.counts([x])[0] == p.count(x) == count_by_chunks(p, x, 16, 4)


@pytest.mark.parametrize("chunk, overlap", [(100, 10), (500, 50), (64, 4)])
def test_resynchronisation(chunk, overlap):
    p = piece_encoder(PIECES)
    long = "a" * 3000 + " b  " + "x yz " * 2000 + "日本" * 500 + "   " * 500
    for x in (long, "z" * 700, ODD[2] * 50):
        assert count_by_chunks(p, x, chunk, overlap) == p.count(x)


def test_stable_places_are_boundaries_whatever_stands_around():
    p = piece_encoder(PIECES)
    rng = random.Random(6)
    for _ in range(200):
        x = "".join(rng.choice("ab zqXj日本語é😀 \n1▁") for _ in range(rng.randint(2, 12)))
        for at in range(1, len(x)):
            if p.stable(x, at):
                ends = set(p.boundaries(x).tolist())
                assert at in ends and p.last_stable(x, at - 1, at + 1) == at


@pytest.mark.parametrize("kind", ["han", "base64", "one letter", "rare places"])
def test_unspaced_text_is_counted_in_linear_time(kind):
    rng = random.Random(7)
    p = piece_encoder(PIECES)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    x = {"han": "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(10**6)), "base64": "".join(rng.choice(letters) for _ in range(10**6)), "one letter": "a" * 10**6, "rare places": ("a" * 16_380 + "é") * 61}[kind]
    began = time.perf_counter()
    want = p.count(x)
    plain = time.perf_counter() - began
    assert count_by_chunks(p, x) == want
    assert time.perf_counter() - began - plain < 5 * plain + 2  # about once over; 2 s for a busy machine


def _check_plan(histogram):
    plan, how = packing.plan(histogram, 2048)
    covered = collections.Counter()
    for config, times in plan:
        assert times > 0 and sum(k * n for k, n in config.items()) <= 2048
        for k, n in config.items():
            covered[k] += n * times
    assert covered == collections.Counter(histogram)
    return sum(t for _, t in plan), how["by_program"] / max(1, how["tokens"])


def _histogram(lengths):
    return collections.Counter(np.clip(np.asarray(lengths).astype(int), 1, 2048).tolist())


@pytest.mark.parametrize("lengths", ["documents", "lognormal", "uniform", "normal"])
def test_the_program_packs(lengths):
    rng = np.random.default_rng(1)
    if lengths == "documents":
        texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
        sizes = np.array([len(x) // 4 + 1 for x in word_encoder(WORDS).ids_bytes([t or "" for t in texts])])
        h = _histogram(np.concatenate([np.full((sizes // 2048).sum(), 2048), sizes[sizes % 2048 > 0] % 2048]))
    else:
        h = _histogram({"lognormal": rng.lognormal(6, 0.9, 3000), "uniform": rng.integers(500, 1101, 20_000), "normal": rng.normal(800, 150, 20_000)}[lengths])
    used, share = _check_plan(h)
    bound = sum(k * n for k, n in h.items()) / 2048
    assert share >= 0.9
    if lengths in ("documents", "lognormal"):
        assert used <= 1.01 * np.ceil(bound)
    else:  # such lengths leave space in any sequence; best fit alone needs more
        k = np.array(sorted(h))
        assert used < sum(n for _, n in packing.best_fit(k, np.array([h[x] for x in k.tolist()]), 2048))


def test_packing_plans():
    assert _check_plan({2048: 3})[0] == 3 and _check_plan({1025: 4})[0] == 4 and _check_plan({1024: 5})[0] == 3
    assert _check_plan({1: 3, 2047: 5})[0] == 5 and _check_plan({5: 100_000})[0] <= 246
    assert packing.plan({}, 2048)[0] == []


def test_the_cover_is_within_its_gap():
    rng = np.random.default_rng(3)
    lengths = np.array([30, 41, 55, 70])
    counts = rng.integers(50, 200, 4).astype(float)
    configurations, times, bound = packing.fractional(lengths, counts, 100, 0.02)
    assert (lengths @ configurations <= 100).all()
    lacking = np.maximum(0, counts - configurations @ times)
    assert times.sum() + (lacking / (100 // lengths)).sum() <= 1.021 * bound
    # the bound holds for every packing: best fit needs no fewer sequences
    assert bound <= sum(n for _, n in packing.best_fit(lengths, counts.astype(int), 100))


def test_knapsack_is_optimal():
    lengths, values = np.array([3, 5, 7]), np.array([3.0, 5.5, 7.2])
    best = max((a * 3.0 + b * 5.5 + c * 7.2 for a in range(7) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 20))
    got = packing.knapsack(lengths, values, 20)
    assert np.isclose(got @ values, best) and got @ lengths <= 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB \t\n.É"), max_size=60), max_size=6))
def test_shingles(texts):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))

    sets = [set(zip(*[w[i:] for i in range(5)])) if len(w := words(t)) >= 5 else {tuple(w)} if w else set() for t in texts]
    got = shingle_sets(texts)
    assert [len(s) for s in got] == [len(s) for s in sets]
    for a, x in zip(sets, got):
        for b, y in zip(sets, got):
            assert len(a & b) == len(np.intersect1d(x, y))


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = np.unique(x[:800]), np.unique(x[100:])
    sa, sb = near_dedup.sketch(a, 2000), near_dedup.sketch(b, 2000)
    assert abs((sa == sb).mean() - 700 / 900) < 0.05
    assert (np.maximum(sa, sb) == near_dedup.sketch(np.unique(x), 2000)).all()
    ra, rb = near_dedup.sketch(a)[None], near_dedup.sketch(b)[None]
    size = np.array([800.0])
    assert near_dedup.plausible(ra, rb, size, size, 0.75)[0]
    other = near_dedup.sketch(np.unique(rng.integers(0, 2**63, 800).astype(np.uint64)))[None]
    assert not near_dedup.plausible(ra, other, size, size, 0.85)[0]


def _base(x):
    return [(m.start(), m.end(), k) for k in pii.KINDS for m in pii.BASE[k].finditer(x) if pii._valid(k, m[0])]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("0123456789.+-() @a%é\n"), max_size=80))
def test_base_spans_are_the_patterns(x):
    assert pii.base_spans(x) == _base(x)


def test_base_spans_on_examples():
    x = "a@b.c d..e@x.y +1 (988) 555-2485, 1.2.3.4.5 999.1.1.1, 4111 1111 1111 1111 é@é.de @@a.b"
    assert pii.base_spans(x) == _base(x) and {k for _, _, k in _base(x)} == set(pii.KINDS)


@pytest.mark.parametrize("x, kind, found", [("write to john.doe (at) mail (dot) com now", "email", "john.doe (at) mail (dot) com"), ("call (988) 555-2485 now", "phone", "(988) 555-2485"), ("use 4338.1234.5678.9010 then", "card", "4338.1234.5678.9010"), ("host 10[.]2[.]3[.]4 ok", "ip", "10[.]2[.]3[.]4")])
def test_added_spans(x, kind, found):
    base, added = pii.all_spans(x, pii.trained())
    assert not base and [(k, x[a:b]) for a, b, k in added] == [(kind, found)]


@pytest.mark.parametrize("x", ["the year 2024-05-06 and 12345678 items", "key = 24be64439e3e49cf46b2d7c90f3602a3", "at noon the dot grew", "", "v1.2.3 build 4567"])
def test_clean_texts_get_no_span(x):
    assert pii.all_spans(x, pii.trained()) == ([], [])


@pytest.mark.parametrize("x, kind, found", [("go to 192 . 168 . 1 . 12 now", "ip", "192 . 168 . 1 . 12"), ("go to 192 .168 .1 .12 now", "ip", "192 .168 .1 .12"), ("write to john at example.com now", "email", "john at example.com")])
def test_spaced_spellings_reach_the_field(x, kind, found):
    assert [(k, x[a:b]) for a, b, k in pii.all_spans(x, pii.trained())[1]] == [(kind, found)]


def _features(tokens, i, j):
    """The features of one segment, one by one."""
    seg = tokens[i:j]
    f = dict.fromkeys(pii.NAMES, 0.0)
    groups = [t for t in seg if t[0] in "0123456789"]
    letters = [t.lower() for t in seg if t[0].isalpha()]
    marks = "".join(t for t in seg if not t[0].isalnum() and not t[0].isspace())
    n = sum(map(len, groups))
    f["bias"], f["tokens"] = 1, len(seg) / 10
    f["digits_4_9"], f["digits_10_11"], f["digits_12_15"], f["digits_16_19"], f["digits_20"] = 4 <= n <= 9, 10 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n >= 20
    f["luhn16"] = 16 <= n <= 19 and pii.luhn("".join(groups))
    f[f"groups_{min(5, max(1, len(groups)))}"] = 1
    f["four_octets"] = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    f["even_groups"] = len(groups) > 2 and len(set(map(len, groups))) == 1
    f["ends_4"] = bool(groups) and len(groups[-1]) == 4
    f["group_333_4"] = [len(g) for g in groups[-3:]] == [3, 3, 4]
    f["plus"], f["brackets"] = seg[0] == "+", "(" in marks and ")" in marks
    f["dots"], f["dashes"], f["colon_slash"], f["comma_money"] = "." in marks, "-" in marks, ":" in marks or "/" in marks, "," in marks or "$" in marks or "€" in marks
    f["other_marks"] = bool(set(marks) - set("+()[]{}<>.-_@:/,$€"))
    spaces = [t for t in seg if t.isspace()]
    f["spaces"], f["line_break"] = bool(spaces), any("\n" in t for t in spaces)
    f["mixed_separators"] = len({t for t in seg if not t.isalnum()}) > 2
    f["has_letters"], f["words_3"] = bool(letters), len(letters) > 4
    at = "@" in seg
    word = next((k for k, t in enumerate(seg) if t.lower() == "at"), -1)
    f["at_sign"], f["at_word"], f["dot_word"] = at, word > 0, "dot" in letters
    pos = seg.index("@") if at else word
    f["dot_after_at"] = pos > 0 and ("." in seg[pos:] or "dot" in [t.lower() for t in seg[pos:]])
    f["long_tail"] = bool(letters) and pos > 0 and 2 <= len(seg[-1]) <= 4 and seg[-1].isalpha() and seg[-1].lower() not in ("at", "dot")
    f["sentence_end"] = any(t in ".!?" and not seg[k].isspace() and seg[k + 2].isspace() for k, t in enumerate(seg[1:-1]))
    tail = [t.lower() for t in seg[pos + 1 :] if not t.isspace() and t not in "()[]{}<>"] if pos > 0 else []
    f["one_host"] = len(tail) > 2 and tail[0].isalnum() and tail[1] in (".", "dot")
    before, after = tokens[i - 1] if i else " ", tokens[j] if j < len(tokens) else " "
    f["digit_neighbour"] = before[0] in "0123456789.-:/$#" or after[0] in "0123456789-:/%"
    f["letter_neighbour"] = before[0].isalpha() or after[0].isalpha()
    f["outer_space"] = before[0].isspace() and (after[0].isspace() or after[0] in ".,;)")
    near = {t.lower() for t in tokens[max(0, i - 4) : i]}
    for k in pii.KINDS:
        f["near_" + k] = bool(near & pii._WORDS[k])
    return np.fromiter(map(float, f.values()), float, pii.FEATURES)


def _segments(tokens):
    """Every candidate, one by one."""
    out = []
    for i in range(len(tokens)):
        n, mark = 0, False
        for j in range(i, min(len(tokens), i + pii.MOST_TOKENS)):
            t = tokens[j]
            n += len(t) if t[0] in "0123456789" else 0
            mark |= t == "@" or t.lower() == "at"
            if "\n" in t and j > i and n > 30:
                break
            if (tokens[i][0].isalnum() or tokens[i] in "+([") and t[0].isalnum() and ((j > i and (n >= 4 or (mark and j - i >= 4))) or n >= 8):
                out.append((i, j + 1))
    return out


def _best(tokens, field):
    """The best segmentation's sum, by a plain dynamic program over all tokens."""
    spans = _segments(tokens)
    top = [float((_features(tokens, i, j) @ field.weights.T).max()) for i, j in spans]
    best = [0.0] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = max([best[j - 1], *(best[i] + s for (i, e), s in zip(spans, top) if e == j)])
    return best[-1]


def test_segments_and_their_features_one_by_one():
    rng = random.Random(2)
    parts = ["john", "word", "at", "AT", "@", "dot", ".", "com", "12", "168", "1", "2024", "(", ")", "+", "-", "\n", "call", "192 . 168 . 1 . 12", "john at example.com", "988 555 2485", "4539 1488 0343 6467", "²", "€", "!", "123456789012345678901", "  "]
    field = pii.trained()
    several = 0
    for _ in range(120):
        x = "".join(rng.choice(["xy " * rng.randint(1, 25), rng.choice(parts)]) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 25)))
        words = pii._TOKEN.findall(x)
        made = pii.Tokens([words])
        first, end, f = made.candidates(made.starts())
        want = _segments(words)
        assert list(zip((first - pii.APART).tolist(), (end - pii.APART).tolist())) == want
        assert all((f[c] == _features(words, i, j)).all() for c, (i, j) in enumerate(want))
        # only stretches around numbers and at-marks are searched, and texts of a batch together; the sum is the whole text's
        parted = pii.stretches(x, 0, len(x))
        several += len(parted) > 1
        tokens = pii.Tokens([w for _, w in parted]) if parted else made
        got = field.decode(tokens)
        one, two, g = tokens.candidates(tokens.starts())
        score = {(a, b): float((v @ field.weights.T).max()) for a, b, v in zip(one.tolist(), two.tolist(), g)}
        assert np.isclose(sum(score[a, b] for a, b, _ in got), _best(words, field))
        assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:]))
        assert pii.find_all(["12", x, None, ""], field)[1] == pii.all_spans(x, field)
    assert several > 10


@pytest.mark.parametrize("x", ["bartholomew.montgomery.featherstone (at) mail (dot) com", "annabelle.christine.vandenberg-montgomery (at) mail (dot) com"])
def test_long_names_are_whole(x):
    for text in (x, f"please write to {x} soon", "word " * 60 + x + " word" * 60):
        assert [text[a:b] for a, b, _ in pii.all_spans(text, pii.trained())[1]] == [x]


def test_added_spans_on_generated_text():
    rng = np.random.default_rng(99)  # not the training's seed
    field, hit, found, gold = pii.trained(), 0, 0, 0
    filler = lambda: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(rng.integers(2, 40)))
    for _ in range(600):
        head = filler() + " "
        body, kind = pii._spellings(rng)
        x = head + body + " " + filler()
        base, added = pii.all_spans(x, field)
        spans = [(a, b, k) for a, b, k in base + added]
        found += len(spans)
        gold += kind is not None
        hit += (len(head), len(head) + len(body), kind) in spans
    assert hit / found >= 0.85 and hit / gold >= 0.85, (hit, found, gold)


def test_long_runs_take_seconds():
    began = time.perf_counter()
    field = pii.trained()
    table = "\n".join(" ".join(str((i * 7919 + j * 104729) % 100_000) for j in range(8)) for i in range(4000))
    for x in ("7" * 1_000_000, "@" + "a" * 1_000_000, "a" * 1_000_000 + "@", "1." * 100_000, "+1(" * 20_000, table):
        base, _ = pii.all_spans(x, field)
        if len(x) < 200_000:
            assert base == _base(x)
    assert time.perf_counter() - began < 60


def test_segment_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    tokens = pii.Tokens([pii._TOKEN.findall("call (988) 555-2485 now")])
    first, end, f = tokens.candidates(tokens.starts())
    spans = list(zip(first.tolist(), end.tolist()))
    w = rng.normal(0, 0.3, (len(pii.KINDS), pii.FEATURES))
    gold = {(*spans[len(spans) // 2], "phone")}

    def likelihood(w):
        s = np.clip(f @ w.T, -30, 30)
        alpha = [0.0]
        for j in range(1, tokens.n + 1):
            alpha.append(np.logaddexp.reduce([alpha[j - 1], *(alpha[i] + s[c, k] for c, (i, e) in enumerate(spans) if e == j for k in range(4))]))
        c = spans.index(next(iter(gold))[:2])
        return s[c, 3] - alpha[-1]

    g = pii._gradient(w, tokens.n, spans, f, gold)
    step = rng.normal(size=w.shape)
    assert np.isclose((likelihood(w + 1e-5 * step) - likelihood(w - 1e-5 * step)) / 2e-5, (g * step).sum(), rtol=1e-3)


def test_redaction():
    assert pii.redact("x a@b.c y", [(2, 7, "email")]) == "x <EMAIL> y"
    assert pii.redact("0123456789", [(1, 5, "card"), (3, 8, "phone")]) == "0<CARD>89"


def test_decontamination_against_brute_force():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(30)).capitalize() + ".") for i in range(20)]
    index = decontamination.Index(items)
    body = " ".join(word() for _ in range(300))
    assert decontamination.spans_of(body, index) == (set(), [])
    for i, item in items:
        edited = list(item)
        for _ in range(int(0.05 * len(item))):
            edited[rng.randrange(len(edited))] = rng.choice(["", "z"])
        for x in (item, item.upper().replace(" ", "\n"), "".join(edited)):
            found, spans = decontamination.spans_of(f"{body} {x} {body}", index)
            assert found == {i} and abs(spans[0][0] - len(body) - 1) <= 12 and abs(spans[-1][1] - len(body) - 1 - len(x)) <= 12
    for x in (None, "", "short", "é" * 5000):
        assert decontamination.spans_of(x, index) == (set(), [])


def test_excerpts_are_found_at_every_offset():
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    item = words(50)
    index = decontamination.Index([(3, item)])
    length, before, after = 60 + 10 - 1, words(40), words(40)
    for a in range(len(item) - length + 1):
        if " " not in (item[a], item[a + length - 1]):
            assert decontamination.spans_of(f"{before} {item[a : a + length]} {after}", index)[0] == {3}, a


def test_alignment_budget():
    t = lambda s: np.frombuffer(s.encode("utf-32-le"), "<u4")
    p = t("abcdefghijklmnop")[None]
    one = lambda x, k: tuple(v.tolist()[0] for v in decontamination.align(p, t(x), np.array([2]), 1, k))
    assert one("xxabcdefghijklmnopxx", 0) == (True, 2, 18)
    assert one("xxabcdefgijklmnopxx", 1) == (True, 2, 17)
    assert not one("xxabcdefgijklmnopxx", 0)[0]


def _edits(pattern, x):
    """The fewest edits with which pattern occurs somewhere in x."""
    row = [0] * (len(x) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(x):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_windows_found_are_those_within_their_budget():
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(n))
    shared = words(20)
    items = [(i, f"{shared} {words(15)}") for i in range(6)]
    index = decontamination.Index(items)
    for _ in range(12):
        x = list(f"{words(20)} {rng.choice([shared, items[3][1]])} {words(20)} {shared} {words(9)}")
        for _ in range(rng.choice([0, 3, 9, 20])):
            x[rng.randrange(len(x))] = rng.choice(["", "z", "zz"])
        x = "".join(x)
        points = decontamination.normalise(x)[0]
        plain = "".join(map(chr, points.tolist()))
        want = set()
        for w in range(len(index.windows)):
            if _edits("".join(map(chr, index.windows[w].tolist())), plain) <= index.budget[w]:
                want |= set(index.items(np.array([w]))[0].tolist())
        assert index.search([x])[0][0] == want


def test_many_items_with_a_common_head(monkeypatch):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(n))
    head = words(30)[:97]
    index = decontamination.Index([(i, f"{head} {words(12)}") for i in range(400)])
    x = " and ".join(head for _ in range(20))
    whole = index.search([x, words(60)])
    assert whole[0][0] == set(range(400)) and whole[1] == (set(), [])
    monkeypatch.setattr(decontamination, "MOST_HITS", 2000)  # memory is bounded by ranges of windows, with equal results
    assert index.search([x])[0] == whole[0]


def test_repetitive_text_and_items(monkeypatch):
    index = decontamination.Index([(1, "a" * 400), (2, "ab " * 60), (3, "tiny"), (4, "--")])
    assert index.search(["a" * 20_000]) == [({1}, [(0, 20_000)])]
    monkeypatch.setattr(decontamination, "MOST_HITS", 5000)
    monkeypatch.setattr(decontamination, "SLICE", 4096)
    assert index.search(["a" * 20_000, "x" + "ab " * 500, "  Tiny.", "a tiny one", "--"]) == [({1}, [(0, 20_000)]), ({2}, [(0, 1501)]), ({3}, [(2, 6)]), (set(), []), (set(), [])]


def test_list_decoding_finds_what_exceeds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = embedding_dedup.Code(16, 8)
    y = x @ code.rotation
    s = [y[:, a:b] @ w.T for (a, b), w in zip(code.parts, code.words)]
    every = s[0][:, :, None, None] + s[1][:, None, :, None] + s[2][:, None, None, :]
    for got, full in zip(code.decode(x), every.reshape(20, -1)):
        above = set(np.flatnonzero(full >= code.threshold).tolist())
        assert above <= set(got.tolist()) or len(got) == embedding_dedup.LEAST
        assert len(got) >= min(embedding_dedup.LEAST, 512)


def test_sign_sketches_keep_links():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * g / np.linalg.norm(g, axis=1, keepdims=True)
    differ = np.bitwise_count((embedding_dedup.sketches(x) ^ embedding_dedup.sketches(y)).view(np.uint64)).sum(1)
    assert differ.max() <= embedding_dedup.most_bits(0.9) < 50


def test_filter_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * g / np.linalg.norm(g, axis=1, keepdims=True)
    code = embedding_dedup.Code(64, *embedding_dedup.code_size(50_000))
    shared = [len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(y))]
    assert np.mean(shared) >= 0.95


@pytest.mark.parametrize("n", [20_000, 200_000, 1_000_000, 4_000_000, 40_000_000])
def test_filter_recall_stays_as_tables_grow(n):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * g / np.linalg.norm(g, axis=1, keepdims=True)
    code = embedding_dedup.Code(64, *embedding_dedup.code_size(n))
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(y))]) >= 0.975


@pytest.mark.parametrize("label", ["and", "xor"])
@pytest.mark.parametrize("words, vocabulary, n", [(12, 60, 1600), (40, 1000, 3000)])
def test_toxicity_learns_an_interaction(label, words, vocabulary, n):
    rng = np.random.default_rng(0)
    docs, y = [], []
    for i in range(n):
        text = [f"w{rng.integers(0, vocabulary)}" for _ in range(words)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append(toxicity.document_terms(" ".join(text + ["insult"] * a + ["people"] * b)))
        y.append(float(a and b) if label == "and" else float(a != b))
    y, cut = np.array(y), n * 3 // 4
    m = toxicity.fit(docs[:cut], y[:cut])
    assert ((m.scores(docs[cut:]) >= 0.5) == y[cut:]).mean() > 0.9


def test_toxicity_scores_are_the_pairwise_sums():
    rng = np.random.default_rng(1)
    theta = rng.normal(0, 0.2, (toxicity.SPACE, toxicity.FACTORS + 1)).astype(np.float32)
    m = toxicity.FactorizationMachine(-0.3, theta)
    docs = [toxicity.document_terms(t) for t in ("You are ALL so very lovely today", "one", "", None, "word " * 30 + "other words here too")]
    want = []
    for d in docs:
        x = 1 / np.sqrt(1 + len(d) / toxicity.TYPICAL)
        z = -0.3 + sum(float(theta[i, 0]) * x for i in d)
        z += sum(float(theta[i, 1:] @ theta[j, 1:]) * x * x for k, i in enumerate(d) for j in d[:k])
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(m.scores(docs), want, atol=1e-5)
    assert toxicity.fit([], np.zeros(0)).scores([np.zeros(0, np.int32)])[0] == 0.5
    assert 0 < toxicity.fit(docs[:2], np.ones(2)).scores([docs[0]])[0] < 1


def test_quality_network_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, 12)).astype(np.float32)
    y = (x[:, 0] - np.abs(x[:, 1]) + 0.3 * rng.normal(size=1000) > 0).astype(float)
    net = quality.fit(x[:800], y[:800])
    p = net.scores(x[800:])
    assert ((p >= 0.5) == y[800:]).mean() > 0.8 and 0.25 <= net.temperature <= 8
    assert quality.fit(x[:3], np.ones(3)).scores(x[:2]).tolist() == [0.8, 0.8]
    v = np.eye(quality.BUCKETS, quality.DIM, dtype=np.float32)
    assert not quality.pool(v, quality.codes(None)).any() and not quality.pool(v, quality.codes("")).any()


def test_context_sums_brute_force():
    place, sign = quality.index_vectors()
    docs = [quality.codes("a b c d a"), quality.codes("b")]
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for d in docs:
        ids = (d >> 2).tolist()
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if 0 < abs(i - j) <= quality.WINDOW:
                    for s in range(quality.NONZERO):
                        want[a, place[b, s]] += sign[b, s]
    assert np.allclose(quality.context_sums(docs), want)


def test_quote_parsing():
    own, quoted = chat.parse("hello\n> one\n> two\n>> deep\nbye\n> three")
    assert own == "hello\nbye" and quoted == [(1, "one\ntwo"), (2, "deep"), (1, "three")]
    assert chat.parse(None) == ("", []) and chat.parse("a > b") == ("a > b", [])
    assert chat.passage_hash("Hello,  WORLD!") == chat.passage_hash("hello world") and chat.passage_hash("--") is None
