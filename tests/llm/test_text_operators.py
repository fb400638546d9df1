"""Chat formatting, quality rules, near-dedup, decontamination, classifier and language model on small tables."""

import math
import os
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from umbra.llm import chat_format
from umbra.llm.components import components
from umbra.llm.decontaminate import STARTERS, UNITS, Decontamination
from umbra.llm.lm_score import SpelledWords, Spelling, WindowModel, WordIds
from umbra.llm.near_dedup import NearDedup
from umbra.llm.common import shared_dir, stored
from umbra.llm.quality_classifier import KneserNey
from umbra.llm.quality_rules import quality_rules, repeated_words

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\", "[\\INST]", "a", "\n", "é", " ", "<", "]", "/"]


def test_chats_are_read_back_exactly(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", "<s>\n", ""]), "".join(r.choice(PARTS) for _ in range(r.randint(0, 12)))) for c in range(60) for t in range(r.randint(1, 6))]
    rows += [(100, 0, "user", None), (100, 1, None, "x"), (101, None, "assistant", "y"), (101, None, "assistant", "y"), (None, 3, "user", "z"), (None, 1, "assistant", "w" * 20_000)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {x.conv_id: x for x in chat_format.digests(chat_format.format_chats(df)).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == sha256(loss.encode()).hexdigest()
    one = chat_format.format_chats(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "</s>"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string"))
    assert one.first().formatted == "<s>user\n[INST]a[/INST][INST]<\\/s>[/INST]</s><s>assistant\n[INST]b[/INST]</s>"
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_repeated_words_match_brute_force():
    r = random.Random(2)
    for _ in range(300):
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 60))]
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        marked = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
        assert repeated_words(words) == len(marked)


def test_quality_rules_take_common_lines(spark):
    own = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(40)]
    rows = [(i, t + "\nTHE  Same line here of eight words in all", "h") for i, t in enumerate(own)]
    rows += [(50 + i, "\n".join(["the same line here of eight words in all"] * 3 + [f"y{i}"]), "h") for i in range(5)]
    rows += [(60, None, "h"), (61, "", None), (None, own[0], "other"), (3, rows[3][1], "h")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, n_words int")
    out = quality_rules(df).collect()
    assert len(out) == len(rows)
    got = {x.doc_id: x for x in out}
    assert all(got[i].kept and got[i].n_common_words == 9 and got[i].n_words == 39 for i in range(40))
    assert all(not got[50 + i].kept and got[50 + i].n_dup_lines == 2 for i in range(5))
    assert got[60].n_words == 0 and not got[60].kept and got[61].base_failed and got[None].kept
    assert quality_rules(df.limit(0)).count() == 0


def test_quality_rules_reject_depleted_documents_of_any_host(spark):
    common = " ".join(f"c{k}" for k in range(30))
    # a host of many texts, where 2 % of them would be more than the limit, and copies of one text
    rows = [(i, f"own words of number {i} " + " ".join(f"z{i}x{k}" for k in range(20)), "hot") for i in range(1200)]
    rows += [(2000 + i, f"{common}\nleft {i}", "hot") for i in range(25)] + [(3000 + i, "\n".join(["a line " + " ".join(f"q{k}" for k in range(25))] * 1), "hot") for i in range(40)]
    rows += [(4000, f"{common}\nleft", "small")]
    out = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_documents=20).collect()}
    assert not any(out[2000 + i].kept or out[2000 + i].base_failed for i in range(25)) and all(out[2000 + i].n_common_words == 30 for i in range(25))
    assert all(out[i].kept for i in range(1200)) and all(out[3000 + i].kept for i in range(40)) and out[4000].kept


def shingled(text, k):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(rows, k, percent):
    sets = [shingled(t, k) for _, t in rows]
    low = [i for i, _ in rows]
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {(i, len(s), m) for (i, _), s, m in zip(rows, sets, low, strict=True)}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_matches_brute_force(spark, k, percent):
    r = random.Random(k)
    words = [f"w{i}" for i in range(200)]
    base = [[r.choice(words) for _ in range(r.choice([1, 2, 4, 9, 40, 150]))] for _ in range(20)]
    rows = []
    for i in range(260):
        w = list(base[0] if i % 3 == 0 else r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((1000 - i, " ".join(w) if i % 2 else " ".join(w).upper()))
    rows += [(5, None), (6, ""), (7, " \n\t ")]
    df = spark.createDataFrame([(*x, 0) for x in [*rows, (1000, rows[0][1])]], "doc_id long, text string, keys int")
    job = NearDedup(words=k, percent=percent)
    out = job.dedup(df).collect()
    assert len(out) == len(rows) + 1
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in out} == groups(rows, k, percent)
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)
    left = [x.doc_id for x in job.keep_one(df).collect()]
    assert sorted(left) == sorted({x.doc_id for x in out if x.kept})
    assert job.dedup(spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")).where("kept").count() == 0
    assert job.dedup(df.limit(0)).count() == 0


def test_near_dedup_removes_by_id_and_text(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (None, text("c")), (None, text("c")), (None, text("a")), (3, text("d")), (3, text("d"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((x.doc_id, x.text) for x in NearDedup().keep_one(df).collect()), key=str)
    assert left == sorted([(1, text("a")), (2, text("b")), (None, text("c")), (3, text("d"))], key=str)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 140)] + [(139, 5), (7, 7)]
    out = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(out[i] == 10 for i in range(10, 61)) and all(out[i] == 5 for i in [5, *range(100, 140)])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM = "a train leaves Paris at 40 km and Tom waits for 12 minutes before he walks home to see the old house again"


def test_decontamination_sees_templates_and_slots(spark):
    changed = ITEM.replace("40", "75").replace("12", "30").replace("Tom", "Anna")
    crossed = "we know that if 5 apples cost 5 coins then 5 pears cost more than that for all of us"
    rows = [
        (1, "Some words before it. " + ITEM + " and after"), (2, "x " + changed), (3, "nothing of the kind in here at all but words and more words so long"),
        (4, crossed.replace("5 apples", "6 apples")), (5, crossed.replace("5", "9")), (6, None), (7, ITEM[:30]), (None, "so: " + ITEM), (1, "Some words before it. " + ITEM + " and after"),
        (8, " ".join(["filler"] * 20_000) + " " + ITEM),
    ]
    docs = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, ITEM, "z"), (11, crossed, "z"), (12, None, "z"), (None, ITEM, "z")], "item_id long, text string, body string")
    d = Decontamination()
    got = {(x.doc_id, x.item_id, x.changed) for x in d.leaks(docs, bench).collect()}
    assert got == {(1, 10, False), (2, 10, True), (5, 11, True), (None, 10, False), (8, 10, False)}
    assert sorted(x.doc_id for x in d.clean(docs, bench).collect()) == [3, 4, 6, 7] and d.clean(docs, bench).columns == docs.columns
    assert d.leaks(docs.limit(0), bench).count() == 0 and d.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_runs_at_any_place_and_slot_rich_copies(spark):
    short = "Tom pays 5 euros and Anna pays 12 dollars while walking"
    rich = "of Anna Bell Carl Dorn Emil Fink 12 kg 30 km 7 mg 9 cm"
    half = ITEM + " and then on one long and cold road he pays 40 coins at last"
    # the first run ends at "and later"; in the second 40 stands for two values
    clash = half.replace("again and then", "again and later").replace("40 coins", "41 coins")
    rows = [(i, " ".join(["word"] * i) + ". " + short) for i in range(1, 9)] + [(20, "see " + rich), (21, clash), (22, "no leak in here, only words that stand one after another for a while")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, short), (2, rich), (3, half)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in Decontamination().leaks(docs, bench).collect()}
    assert got == {*((i, 1) for i in range(1, 9)), (20, 2), (21, 3)}


def plain_tokens(text):
    """(template token, value) of a text by plain steps."""
    out = []
    for word in text.split():
        value = regex.sub(r"[^\p{L}\p{N}\s.,:/%€$£°]+|[.,:/]+(?=\s|$)", "", word).lower()
        token = regex.sub(r"(?<![\p{L}\p{N}'’-])\p{Lu}[\p{L}'’-]*", lambda m: m[0] if m[0] in STARTERS.split() else "<name>", word)
        token = regex.sub(r"\d+(?:[.,:/]\d+)*", "<num>", token)
        out.append([token, value])
    joined = " ".join(t for t, _ in out)
    joined = regex.sub(rf"(<num>\s?)(?i:{'|'.join(UNITS.split())})(?!\p{{L}})|(<num>)[%€$£°]", lambda m: (m[1] or m[2]) + "<unit>", joined)
    tokens = [regex.sub(r"[^\p{L}\p{N}<>\s]+", "", t).lower() for t in joined.split(" ")]
    return [(t, v) for t, (_, v) in zip(tokens, out, strict=True) if t]


def plain_leak(doc, item, run=11, width=8, literals=4):
    """Whether any alignment has a long enough run whose placeholders agree and that holds a window that is looked for."""
    need = min(run, len(item))
    slot = lambda t: "<" in t
    for shift in range(-len(item), len(doc)):
        ends, at = [], 0
        for j in range(len(item) + 1):
            same = j < len(item) and 0 <= j + shift < len(doc) and item[j][0] == doc[j + shift][0]
            if not same:
                ends.append((at, j))
                at = j + 1
        for low, high in ends:
            pairs = [(item[j], doc[j + shift]) for j in range(low, high)]
            seen = {(i[0], i[1], d[1]) for i, d in pairs if slot(i[0])}
            fair = len(seen) == len({x[:2] for x in seen}) == len({(x[0], x[2]) for x in seen})
            windows = [pairs[k : k + width] for k in range(len(pairs) - width + 1)]
            probed = any(sum(not slot(i[0]) for i, _ in w) >= literals or [i[1] for i, _ in w] == [d[1] for _, d in w] for w in windows)
            if high - low >= need and fair and probed:
                return True
    return False


def test_decontamination_matches_brute_force(spark):
    r = random.Random(21)
    plain = ["of", "and", "pays", "runs", "over", "a", "road", "for", "then", "tea"]
    made = lambda p: r.choice(["Tom", "Anna", "Paris", "The", "When"]) if r.random() < p else str(r.randint(2, 40)) if r.random() < p else r.choice(["km", "kg", "30%", "5.5"]) if r.random() < p / 2 else r.choice(plain)
    items = [" ".join(made(p) for _ in range(n)) for p in (0.05, 0.3, 0.8, 0.95) for n in (5, 8, 10, 11, 14, 24) for _ in range(2)]
    rows = []
    for i in range(160):
        words = r.choice(items).split()
        low = r.randint(0, max(0, len(words) - 6)) if i % 3 == 0 else 0
        words = words[low : r.randint(low + 5, len(words) + 5)]
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(words))
            words[k] = str(r.randint(2, 40)) if words[k].isdigit() else r.choice(["Tom", "Emil"]) if words[k][0].isupper() else r.choice(plain)
        rows.append((i, " ".join([made(0.3) for _ in range(r.randint(0, 5))] + words + [made(0.3) for _ in range(r.randint(0, 5))])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in Decontamination().leaks(docs, bench).collect()}
    own = [plain_tokens(t) for t in items]
    want = {(i, k) for i, t in rows for k, item in enumerate(own) if len(item) >= 8 and plain_leak(plain_tokens(t), item)}
    assert got == want and len(want) > 30


def test_decontamination_sees_changed_names_at_the_start(spark):
    docs = spark.createDataFrame([(1, "Anna walks along the long road to town and buys some tea")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Tom walks along the long road to town and buys some tea")], "item_id long, text string")
    assert [(x.longest_run, x.changed) for x in Decontamination().leaks(docs, bench).collect()] == [(12, True)]


def kneser_ney(texts, order, open_words, least=2):
    """Probabilities by plain counting: a function of (history, word)."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        w = ["^"] * (order - 1) + t.split()
        for i in range(order - 1, len(w)):
            for n in range(1, order + 1):
                counts[n][tuple(w[i - n + 1 : i + 1])] += 1
    used = [None, *(Counter() for _ in range(order))]
    used[order] = counts[order]
    for n in range(1, order):
        for g in counts[n + 1]:
            used[n][g[1:]] += 1
    cut = [None]
    for n in range(1, order + 1):
        m = [0] + [max(sum(v == c for v in used[n].values()), 1) for c in range(1, 5)]
        y = m[1] / (m[1] + 2 * m[2])
        cut.append([min(max(c - (c + 1) * y * m[c + 1] / m[c], 0.1), c - 0.05) for c in (1, 2, 3)])

    def p(history, word):
        n = len(history) + 1
        lower = p(history[1:], word) if history else 1 / open_words
        own = {g: c for g, c in used[n].items() if g[:-1] == history}
        total = sum(own.values())
        if not total:
            return lower
        d = lambda c: c if n > 1 and c < least else cut[n][min(c, 3) - 1]
        c = own.get((*history, word), 0)
        return (c - d(c) if c else 0) / total + sum(d(c) for c in own.values()) / total * lower

    return p


def test_kneser_ney_matches_plain_counting(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 25))) for _ in range(40)]
    asked = [*texts[:10], "a b zz c", "zz", " h\th \n h h  ", "", " "]
    df = spark.createDataFrame(list(enumerate(asked)), "k int, text string")
    for least, rows in ((2, 10_000), (1, 1)):  # joined by broadcast, and by shuffle
        kn = KneserNey(least=least, broadcast_rows=rows)
        model = stored(kn.fit(spark.createDataFrame([(t,) for t in texts], "text string")), "test-model")
        p = kneser_ney(texts, 3, kn.open_words, least)
        got: dict = {}
        for x in kn.word_log_probabilities(df, model, "k").collect():
            got.setdefault(x.k, []).append((x.log_p, x.again))
        for k, t in enumerate(asked):
            padded = ["^", "^", *t.split()]
            want = sorted((math.log(p(tuple(padded[i : i + 2]), padded[i + 2])), padded[i + 1] == padded[i + 2]) for i in range(len(padded) - 2))
            assert len(want) == len(got.get(k, [])) and all(abs(a - b) < 1e-6 and x == y for (a, x), (b, y) in zip(sorted(got.get(k, [])), want, strict=True))
        everything = sum(math.exp(math.log(p(("a", "b"), w))) for w in "abcdefgh") + p(("a", "b"), "?") * (kn.open_words - 8)
        assert abs(everything - 1) < 1e-6


def test_classifier_limits_and_verdicts_match_plain_ones(spark):
    r = random.Random(12)
    lexicon = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(lexicon) if r.random() < 0.95 else f"x{r.random()}" for _ in range(r.randint(5, 60))), "en" if i % 3 else "de") for i in range(300)]
    rows += [(400 + i, " ".join(["word1"] * n), "en") for i, n in enumerate((1, 2, 4, 8, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    kn = KneserNey(sample_chars=20_000, quantile=0.9, slack=0.0, repeat_slack=0.0)
    out = {x.doc_id: x for x in kn.classify(docs, labels).collect()}
    trusted = docs.join(labels, "doc_id").select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"))
    sample = {x.doc_id for x in kn.trusted_sample(trusted).collect()}
    assert 0 < len(sample) < 150
    p = kneser_ney([t for i, t, _ in rows if i in sample], 3, kn.open_words)
    sums = {}
    for i, t, lang in rows:
        w = ["^", "^", *t.split()]
        sums[i] = lang, len(w) - 2, sum(math.log(p(tuple(w[k : k + 2]), w[k + 2])) for k in range(len(w) - 2)), sum(w[k + 1] == w[k + 2] for k in range(len(w) - 2))
    for lang in ("en", "de"):
        own = {i: x[1:] for i, x in sums.items() if x[0] == lang}
        n = sum(x[0] for x in own.values())
        h = {i: -(x[1] + 20 * sum(y[1] for y in own.values()) / n) / (x[0] + 20) for i, x in own.items()}
        again = {i: (x[2] + 20 * sum(y[2] for y in own.values()) / n) / (x[0] + 20) for i, x in own.items()}
        held = [i for i in own if i < 300 and i % 2 == 0 and i not in sample]
        at = lambda v: sorted(v[i] for i in held)[math.ceil(0.9 * len(held)) - 1]  # noqa: E731, B023
        for i in own:
            assert out[i].perplexity == pytest.approx(math.exp(h[i])) and out[i].limit == pytest.approx(math.exp(at(h))) and out[i].most_repeats == pytest.approx(at(again))
            assert out[i].kept == (out[i].perplexity <= out[i].limit and out[i].repeats <= out[i].most_repeats)
        # a text at its limit is kept
        assert any(out[i].repeats == out[i].most_repeats for i in held) and all(out[i].kept for i in held if out[i].perplexity <= out[i].limit and out[i].repeats == out[i].most_repeats)


def test_classifier_is_fitted_on_all_trusted_text(spark):
    """Other texts are scored by all trusted ones, each trusted one by the other half, and limits are those of all trusted ones."""
    r = random.Random(5)
    lexicon = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(lexicon) for _ in range(r.randint(5, 40))) + f" own{i}", "en") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    kn = KneserNey(quantile=0.9, slack=0.0)
    out = {x.doc_id: x for x in kn.classify(docs, labels).collect()}
    halves = {x.doc_id: x.h for x in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(2)).alias("h")).collect()}
    models = {h: kneser_ney([t for i, t, _ in rows if i < 80 and halves[i] != h], 3, kn.open_words) for h in (0, 1, None)}
    logs, sizes = {}, {}
    for i, t, _ in rows:
        w = ["^", "^", *t.split()]
        p = models[halves[i] if i < 80 else None]
        logs[i], sizes[i] = sum(math.log(p(tuple(w[k : k + 2]), w[k + 2])) for k in range(len(w) - 2)), len(w) - 2
    mean = sum(logs.values()) / sum(sizes.values())
    h = {i: -(logs[i] + 20 * mean) / (sizes[i] + 20) for i in logs}
    high = sorted(h[i] for i in range(80))[math.ceil(0.9 * 80) - 1]
    for i in out:
        assert out[i].perplexity == pytest.approx(math.exp(h[i])) and out[i].limit == pytest.approx(math.exp(high))


def test_classifier_in_parts_gives_the_same_and_leaves_no_models(spark):
    """Slices and rounds change no figure, and what is counted is removed."""
    r = random.Random(6)
    lexicon = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(lexicon) for _ in range(r.randint(0, 40))), "en") for i in range(60)] + [(i, "word1 word2 word3", "en") for i in range(60, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    whole, parts = ({x.doc_id: x for x in KneserNey(part_chars=n).classify(docs, labels).collect()} for n in (8_000_000, 1000))
    assert len(whole) == 90 and all(parts[i].n_words == x.n_words and parts[i].kept == x.kept and parts[i].perplexity == (x.perplexity and pytest.approx(x.perplexity)) and parts[i].limit == pytest.approx(x.limit) for i, x in whole.items())
    left = {x.split("-")[2] for x in set(os.listdir(folder)) - before if x.startswith("umbra-kn-")}
    assert left == {"halves", "scores", "sums", "limits"}


def test_classifier_keeps_good_and_rejects_junk(spark):
    r = random.Random(9)
    lexicon = [f"word{i}" for i in range(60)]
    good = [(i, " ".join(r.choice(lexicon) for _ in range(80)), "en") for i in range(200)]
    junk = [(500 + i, " ".join(f"J{r.random()}" for _ in range(80)), "en") for i in range(20)]
    junk += [(600, good[0][1] + " word3" * 60, "en"), (601, "word5 " * 90, "en")]
    rows = [*good, *junk, (900, None, "en"), (901, "words of a strange tongue", "xx"), (902, " ", None), (903, good[3][1] + " " + good[5][1] * 300, "en"), good[0]]
    docs = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([*((i, 1, 0) for i in range(0, 200, 2)), *((500 + i, 0, 0) for i in range(5)), (None, 1, None)], "doc_id long, quality int, toxic int")
    out = KneserNey().classify(docs, labels).collect()
    assert len(out) == len(rows)
    got = {x.doc_id: x.kept for x in out}
    assert sum(got[i] for i in range(200)) >= 196 and not any(got[i] for i, *_ in junk) and all(got[i] for i in (900, 901, 902, 903))
    assert KneserNey().keep_good(docs, labels).columns == docs.columns
    assert KneserNey().classify(docs.limit(0), labels).count() == 0 and KneserNey().classify(docs, labels.limit(0)).where("kept").count() == len(rows)


def test_window_model_learns_from_both_sides(spark):
    r = random.Random(10)
    rows = [(i, " ".join(w for _ in range(60) for w in r.choice([("the", "cat", "sat"), ("a", "dog", "ran")]))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (900, None), (901, " "), (902, "cat the ran dog a sat " * 30), rows[0]], "doc_id long, text string")
    model = WindowModel(known=8, hashed=8, classes=16, size=8, rounds=2, batch=64, shard_words=100_000)
    got = {x.doc_id: x for x in model.score(docs).collect()}
    assert got[900].log_p == 0 and got[900].mean_log_p is None and got[901].n_words == 0
    fluent = np.mean([got[i].mean_log_p for i in range(60)])
    assert fluent > got[902].mean_log_p + 0.5 and fluent > -1.5
    again = {x.doc_id: x.log_p for x in model.score(docs.repartition(7)).collect()}
    assert all(again[i] == pytest.approx(got[i].log_p, rel=1e-5) for i in again)
    assert model.score(docs.limit(0)).count() == 0


def test_window_model_matches_plain_loops(spark):
    r = random.Random(14)
    rows = [(i, " ".join(r.choice(["a", "bb", "cat", "rare", "rat", "zoé", "x" * 30]) for _ in range(r.randint(0, 12)))) for i in range(30)] + [(None, "a cat"), (77, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = WindowModel(known=2, hashed=4, classes=16, size=4)
    counted = model.counted(docs)
    vocabulary = model.vocabulary(counted)
    spelling = model.spelling(counted, vocabulary)
    weights = [w * 5 for w in model.start()]
    got = {x.doc_id: (x.n_words, x.log_p) for x in model.scored(docs, vocabulary, spelling, weights).collect()}
    every = Counter(w for _, t in rows for w in (t or "").encode().split())
    assert sorted(vocabulary) == sorted(w for w, _ in sorted(every.items(), key=lambda x: (-x[1], x[0]))[:2])
    two, one = Counter(), Counter()
    for w, n in every.items():
        if w not in vocabulary:
            for k in range(1, len(w) + 1):
                key = (w[k - 2] if k > 1 else 0, w[k - 1], w[k] if k < len(w) else 256)
                two[key] += n
                one[key[1:]] += n

    def spelled(w):
        total = 0.0
        for k in range(1, len(w) + 1):
            a, b, c = (w[k - 2] if k > 1 else 0, w[k - 1], w[k] if k < len(w) else 256)
            low = (one[b, c] + 5 / 257) / (sum(v for x, v in one.items() if x[0] == b) + 5)
            total += math.log((two[a, b, c] + 5 * low) / (sum(v for x, v in two.items() if x[:2] == (a, b)) + 5))
        return total

    ids = WordIds(vocabulary, 4)
    embed, to_group, to_word = weights
    for i, t in rows:
        words, total = (t or "").encode().split(), 0.0
        for k, w in enumerate(words):
            h = np.zeros(4)
            for j, d in enumerate((-2, -1, 1, 2)):
                h += embed[j][ids[words[k + d]] >> 16 if 0 <= k + d < len(words) else model.ids]
            h = np.append(np.tanh(h), 1)
            target = vocabulary.get(w, 2 + w[0])
            for scores, at in ((h @ to_group, target // model.each), (h @ to_word[target // model.each], target % model.each)):
                total += scores[at] - math.log(np.exp(scores).sum())
            total += 0 if w in vocabulary else spelled(w)
        assert got[i] == (len(words), pytest.approx(total, rel=1e-4, abs=1e-4))


def test_only_rare_words_are_spelled():
    """Words with ids of their own are not looked up, let alone spelled; the table of two bytes gives what the formula gives."""
    words = [b"abc", b"abd", b"xy", b"a"]
    cells, _ = Spelling.cells_of(words)
    keys, n = np.unique(cells, return_counts=True)
    spelling = Spelling(keys, n)
    asked = SpelledWords(spelling)
    got = asked.of([[b"known", b"abc"], [], [b"zq", b"known"]], np.array([False, True, True, False]))
    assert set(asked) == {b"abc", b"zq"} and got[0] == got[3] == 0
    own = dict(zip(spelling.cells.tolist(), spelling.own.tolist(), strict=True))
    for word, value in ((b"abc", got[1]), (b"zq", got[2])):
        found, _ = Spelling.cells_of([word])
        assert value == pytest.approx(sum(own.get(c, spelling.least[c // 257] + spelling.base[c % 65792]) for c in found.tolist()), rel=1e-5)


def test_spelling_is_a_distribution():
    spelling = Spelling(*(np.array(x) for x in zip(*Counter(Spelling.cells_of([b"ab", b"abc", b"b", b"ab"])[0].tolist()).items(), strict=True)))
    # all symbols after a context
    context = 0 * 256 + ord("a")
    cells = context * 257 + np.arange(257)
    at = np.minimum(np.searchsorted(spelling.cells, cells), len(spelling.cells) - 1)
    logs = np.where(spelling.cells[at] == cells, spelling.own[at], spelling.least[context] + spelling.base[cells % 65792])
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_window_model_is_a_distribution_and_ignores_the_word_itself():
    model = WindowModel(known=2, hashed=8, classes=4, size=8)
    ids = WordIds({b"a": 0, b"b": 1}, 8)
    targets, around, sizes = model.windows([b"a b x a".split(), [], [b"b"]], ids)
    assert sizes.tolist() == [4, 0, 1] and around[:, 0].tolist() == [model.ids, model.ids, 1, ids[b"x"] >> 16] and around[:, 4].tolist() == [model.ids] * 4
    assert targets.tolist() == [0, 1, 2 + ord("x"), 0, 1]
    weights = model.start()
    every = [model.log_probabilities(weights, np.full(len(targets), i), around) for i in range(model.ids)]
    assert model.ids <= model.classes * model.each < model.ids + model.classes
    # places of a group beyond the last id take what is left
    assert np.all(np.exp(every).sum(axis=0) <= 1 + 1e-5) and np.all(np.exp(every).sum(axis=0) > 1 - 2 * model.classes / model.ids)


def test_window_model_probabilities_of_small_and_large_weights():
    """Exponentials without a largest value taken off are used only where all outputs are small; all words have probability one together either way."""
    from umbra.llm.lm_score import bounded

    model = WindowModel(known=20, hashed=5, classes=24, size=8)
    around = np.random.default_rng(2).integers(0, model.ids, (2 * model.side, 1))
    for scale in (1, 300):
        weights = [w * np.float32(scale) for w in model.start()]
        assert bounded(weights[1]) == bounded(weights[2]) == (scale == 1)
        every = np.arange(model.classes * model.each)
        logs = model.log_probabilities(weights, every, np.repeat(around, len(every), axis=1))
        assert np.isfinite(logs).all() and np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)
        hidden = model.hidden(weights, around)[0].astype(float)
        a, b = hidden @ weights[1], hidden @ weights[2].astype(float)
        want = (a - np.logaddexp.reduce(a))[:, None] + b - np.logaddexp.reduce(b, axis=1)[:, None]
        assert np.allclose(logs, want.ravel(), rtol=1e-4, atol=1e-3)
        model.step(weights, every, np.repeat(around, len(every), axis=1))
        assert all(np.isfinite(w).all() for w in weights)
