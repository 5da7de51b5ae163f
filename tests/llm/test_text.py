"""Tokenizer, personal data, language, licences and quality."""

import itertools
import math
import pathlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
from helpers import awkward, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curafold.llm import bpe, langid, licence_texts, licences, pii, quality
from curafold.llm.catalog import TOKENIZER

FOLDER = "/root/testdata/sf0.01"


def digest(text):
    return sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def encoder():
    return bpe.WordEncoder(bpe.load_model(TOKENIZER))


def same_as_library(encoder, texts):
    library = Tokenizer.from_file(TOKENIZER)
    for text, (ids, shown), want in zip(texts, encoder.texts(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == " ".join(map(str, want.ids)), text
        assert shown == library.decode(want.ids, skip_special_tokens=False), text


def test_bpe_equals_the_library(encoder):
    rng = random.Random(1)
    signs = "abcdefghijklmnopqrstuvwxyz    '''sstd.,!?-—éèüßñΣσςİıÅÁé \x1c\x85\t\n0123456789½²Ⅷ漢字😀<|>endoftext/w​_"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(1, 18))) for _ in range(4000)]
    texts += ["", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "x" * 5000, "!" * 3000, "ab" * 200 + "!?" * 100]
    same_as_library(encoder, texts)


def test_bpe_merges_alike_by_scan_and_by_heap(encoder):
    rng = random.Random(2)
    for _ in range(300):
        symbols = [rng.choice("etaoinshr") for _ in range(rng.randint(1, 30))] + ["e</w>"]
        assert encoder.merge(symbols) == encoder.merge_long(symbols)


def test_bpe_of_tables(spark):
    docs = awkward(spark)
    got = bpe.encode_documents(docs, TOKENIZER, full=True).collect()
    library = Tokenizer.from_file(TOKENIZER)
    assert len(got) == docs.count()
    for r, text in zip(got, [x.text for x in docs.collect()], strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.ids_sha256 == digest(" ".join(map(str, want)))
        assert r.decoded_sha256 == digest(library.decode(want, skip_special_tokens=False)) == digest(r.decoded)
    assert bpe.encode_documents(empty(spark), TOKENIZER).count() == 0
    real = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for r in bpe.encode_documents(real, TOKENIZER, keep=("text",), full=True).collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(pii.digits(m[0])) <= 19 and pii.luhn(pii.digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(pii.digits(m[0])) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    for _ in range(30_000):
        text = "".join(rng.choice("a0123456789@@..-- +()%é\n9876") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_skip_chains_complete_entities_and_nothing_else(spark):
    texts = [
        "Call +1 555 010 9999 today. Later 1-555-010-9999 or 1 (555) 010 9999 again.",
        "a.b@x.org wrote; reach a.b at x.org or a.b [at] x dot org",
        "card 4111 1111 1111 1111 and 4111.1111.1111.1111 but not 7536784127813050",
        "order 7536784127813050 and 9807915762804490 are numbers, 1-555-010-9999 alone too",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(docs).collect():
        text = texts[r.doc_id]
        base = pii.written(plain_spans(text))
        assert r.base_sha256 == digest(base) and set(filter(None, base.split(","))) <= set(r.spans.split(","))
        added = sorted(text[int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s and s not in base.split(",")))
        want = [["1 (555) 010 9999", "1-555-010-9999"], ["a.b [at] x dot org", "a.b at x.org"], ["4111.1111.1111.1111"], []][r.doc_id]
        assert added == want and r.n_added == len(want)


@pytest.mark.parametrize("copies", [3, 20, 500])
@pytest.mark.parametrize("pairs", [np.zeros((5, 5)), np.eye(5) * 1e6, (1 - np.eye(5)) * 1e6], ids=["level", "alike", "unlike"])
def test_every_copy_of_a_base_match_is_found(copies, pairs):
    cases = [("a.b@x.org", "a.b at x dot org", "email"), ("4111 1111 1111 1111", "4111.1111.1111.1111", "card"), ("+1 555 010 9999", "555.010.9999", "phone")]
    for base, copy, kind in cases:
        # Shapes seen a million times, never as a match.
        field = pii.Field({pii.shape(x): [1_000_000, 0, 0, 0, 0] for x in (copy, "753.678.4127")}, pairs)
        for place in (0, copies // 2, copies):
            lines = [copy] * copies
            lines.insert(place, base)
            text = "\n".join([f"see {x};" for x in [*lines, *["753.678.4127"] * 2]])
            got, settled = field.infer(text, pii.mentions(text)[1])
            assert settled and [(k, text[a:b]) for k, a, b in got] == [(kind, copy)] * copies


def exact_labels(field, text, nodes):
    """Most probable label of each open node by summing over all labellings; entities of a key are summed out."""
    members = field.linked(text, nodes)
    open_ = [i for i, (*_, label) in enumerate(nodes) if label < 0]
    weight = np.zeros((len(nodes), 5))
    for free in itertools.product(range(5), repeat=len(open_)):
        labels = [label for *_, label in nodes]
        for i, k in zip(open_, free, strict=True):
            labels[i] = k
        log = sum(field.unary[pii.shape(text[a:b])][labels[i]] for i, (a, b, label) in enumerate(nodes) if label < 0)
        log += sum(field.chain[x, y] for x, y in zip(labels, labels[1:]))
        for (_, strength), at in members.items():
            inner = [i for i in at if i in open_]
            log += strength * sum(labels[i] == labels[j] for i in inner for j in at if j not in open_)
            if len(inner) > 1:
                log += np.log(sum(np.exp(strength * sum(labels[i] == e for i in inner)) for e in range(5)))
        for i, k in enumerate(labels):
            weight[i, k] += np.exp(log)
    return [int(weight[i].argmax()) for i in open_]


def test_inference_equals_exact_marginals_on_small_documents():
    rng = random.Random(8)
    pool = ["+1 555 010 9999", "555.010.9999", "1-555-010-9999", "a.b@x.org", "a.b at x dot org", "753.678.4127", "4111 1111 1111 1111", "4111.1111.1111.1111", "+44 20 7946 0958"]
    checked = 0
    for _ in range(150):
        text = "; ".join(rng.choice(pool) for _ in range(rng.randint(3, 6)))
        nodes = pii.mentions(text)[1]
        if not 0 < sum(label < 0 for *_, label in nodes) <= 4:
            continue
        shapes = {pii.shape(text[a:b]): [rng.choice([1, 5, 40]), *(rng.choice([0, 0, 3]) for _ in range(4))] for a, b, _ in nodes}
        field = pii.Field(shapes, np.array([[rng.choice([1, 10]) for _ in range(5)] for _ in range(5)], float))
        if not field.linked(text, nodes):
            continue
        got = {(a, b): k for k, a, b in field.infer(text, nodes)[0]}
        want = exact_labels(field, text, nodes)
        open_ = [(a, b) for a, b, label in nodes if label < 0]
        assert [pii.LABELS.index(got.get(n, "none")) for n in open_] == want, text
        checked += 1
    assert checked > 40


def test_shapes_beyond_the_broadcast_count_alike(spark):
    rng = random.Random(6)
    signs = [".", "-", " ", "/", ":", "--", ". "]
    rows = []
    for i in range(80):
        n = f"{rng.randrange(10**9, 10**10)}"
        cut = sorted(rng.sample(range(1, 10), 3))
        other = "".join(c + (rng.choice(signs) if k in cut else "") for k, c in enumerate(n, 1))
        rows.append((i, f"call +{n} or {other} or {other}" if i % 2 else f"number {other}"))
    docs = spark.createDataFrame([*rows, (None, None), (None, "")], "doc_id long, text string").repartition(4)
    want = sorted(map(repr, pii.find_personal_data(docs).collect()))
    assert sum("n_added=2" in r for r in want) > 20
    for kept in (0, 3):
        assert sorted(map(repr, pii.find_personal_data(docs, kept).collect())) == want
    assert pii.shape("1.2" * 50) != pii.shape("1.2" * 51) and len(pii.shape("1.2" * 50)) == 64


def valid_card(rng):
    body = [rng.randrange(10) for _ in range(15)]
    return next("".join(map(str, [*body, c])) for c in range(10) if pii.luhn("".join(map(str, [*body, c]))))


def with_mentions(texts, seed=11):
    """Every third text gets base matches, other writings of the same ones, and look-alikes of other people; the rest
    get look-alikes only. Gives the texts and, by text, the spans of the other writings."""
    rng = random.Random(seed)
    out, wanted = [], []
    for i, text in enumerate(texts):
        n, c, who = "".join(rng.choices("23456789", k=10)), valid_card(rng), "".join(rng.choices("bcdfgh", k=6))
        phone = (f"+1 {n[:3]} {n[3:6]} {n[6:]}", [f"1-{n[:3]}-{n[3:6]}-{n[6:]}", f"({n[:3]}) {n[3:6]} {n[6:]}", f"1.{n[:3]}.{n[3:6]}.{n[6:]}", f"1{n}"])
        fours = [c[j : j + 4] for j in range(0, 16, 4)]
        card = (" ".join(fours), [".".join(fours), "_".join(fours), "/".join(fours)])
        mail = (f"{who}@x-{who}.org", [f"{who} at x-{who} dot org", f"{who} [at] x-{who} [dot] org", f"{who.upper()} AT X-{who.upper()} DOT ORG", f"{who} (at) x-{who}.org"])
        pieces = [(x, False) for x in (text or "").split(" ")]
        extra = []
        if i % 3 == 0:
            for base, others in rng.sample([phone, card, mail], rng.randint(1, 3)):
                extra += [(base, False)] + [(x, True) for x in rng.choices(others, k=rng.randint(1, 5))]
        # Order numbers, digits of a phone number that end otherwise, and addresses that no base match stands for.
        m = "".join(rng.choices("0123456789", k=9))
        extra += [("8" + m * 2 + "1", False), (f"1-{n[:3]}-{n[3:6]}-{m[:4]}", False), (f"{who[::-1]}q at y-{who} dot org", False), (f"{m[:4]}.{m[4:8]}.{m[:4]}.{m[1:5]}", False)]
        for x in extra:
            at = rng.randint(0, len(pieces))
            pieces[at:at] = [("ref", False), x, (", so", False)]
        parts, spans, size = [], set(), 0
        for x, is_other in pieces:
            if is_other:
                spans.add((size, size + len(x)))
            parts.append(x)
            size += len(x) + 1
        out.append(" ".join(parts))
        wanted.append(spans)
    return out, wanted


def added_spans(spark, texts):
    """By text, the spans that the field adds to the base matches."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [set() for _ in texts]
    for r in pii.find_personal_data(docs).collect():
        base = {(a, b) for _, a, b in pii.base_spans(texts[r.doc_id])}
        out[r.doc_id] = {(int(a), int(b)) for _, a, b in (x.split(":") for x in r.spans.split(",") if x)} - base
    return out


def test_added_spans_of_planted_mentions(spark):
    texts, wanted = with_mentions([r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()])
    got = added_spans(spark, texts)
    hits = sum(len(a & b) for a, b in zip(got, wanted, strict=True))
    assert hits >= 0.95 * sum(map(len, wanted)) and hits >= 0.95 * sum(map(len, got))
    assert not any(a for i, a in enumerate(got) if i % 3)


def test_personal_data_of_tables(spark):
    docs = awkward(spark)
    got = pii.find_personal_data(docs)
    assert got.count() == docs.count() and got.where("spans = '' AND n_email + n_ip + n_card + n_phone = 0").count() == docs.count()
    assert pii.find_personal_data(empty(spark)).count() == 0
    assert pii.redacted("x a@b.c y +1 555 010 9999", plain_spans("x a@b.c y +1 555 010 9999")) == "x <email> y <phone>"


def test_long_digit_runs_take_linear_time():
    assert pii.base_spans("9" * 300_000 + " +" + "1" * 300_000) == []


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(got) == docs.count() and len(held) > 150
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_knows_every_word(spark):
    rng = random.Random(5)
    tongue = {"big": "abcdefgh", "mid": "abcdwxyz", "low": "defgwxyz"}
    vocabulary = {x: ["".join(rng.choice(signs) for _ in range(rng.randint(3, 7))) for _ in range(300)] for x, signs in tongue.items()}
    texts = [(x, " ".join(rng.choices(vocabulary[x], k=30) + [f"{x}é{i}" for i in range(2)])) for x, n in (("big", 300), ("mid", 40), ("low", 12)) for i in range(n)]
    rows = [(i, t, x) for i, (x, t) in enumerate(texts)] + [(9000 + i, None if i == 1 else "" if i == 2 else "zzzzq 漢字", None) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    wanted = {r.doc_id: r for r in langid.identify(docs, 10**6, 10**6).collect()}
    for kept in ((0, 0), (20, 10), (10**6, 10)):
        got = langid.identify(docs, *kept).collect()
        assert len(got) == len(rows) and all(r == wanted[r.doc_id] for r in got)
    assert all(wanted[i].lang_pred == x for i, _, x in rows if x)
    truth = plain_language(rows)
    for i, r in wanted.items():
        assert (r.lang_pred, r.held_out) == truth[i][:2] and r.score == pytest.approx(truth[i][2], abs=1e-6)


def plain_language(rows):
    """Prediction of each row from plain counts of words and n-grams."""
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    learn = [(t, x) for i, t, x in rows if x is not None and t is not None and not held[i]]
    langs = sorted({x for _, x in learn})
    prior = {x: math.log(sum(y == x for _, y in learn) / len(learn)) for x in langs}
    counts = [defaultdict(Counter), defaultdict(Counter)]
    for t, x in learn:
        for w in langid.words(t):
            counts[0][w][x] += 1
            for n in range(1, 5):
                for g in [w[k : k + 1] for k in range(len(w))] if n == 1 else [f"^{w}$"[k : k + n] for k in range(len(w) + 3 - n)]:
                    counts[1][n, g][x] += 1
    base = [{x: sum(c[x] for c in table.values()) + 0.5 * (len(table) + 1) for x in langs} for table in counts]
    score = lambda which, item, x: math.log((counts[which][item][x] + 0.5) / base[which][x])
    out = {}
    for i, t, _ in rows:
        total = dict(prior)
        for w in langid.words(t or ""):
            if w in counts[0]:
                for x in langs:
                    total[x] += score(0, w, x)
                continue
            for n in (4, 3, 2, 1):
                found = [g for g in ([w[k : k + 1] for k in range(len(w))] if n == 1 else [f"^{w}$"[k : k + n] for k in range(len(w) + 3 - n)]) if (n, g) in counts[1]]
                if found:
                    for x in langs:
                        total[x] += sum(score(1, (n, g), x) for g in found) / len(found)
                    break
        best = max(langs, key=lambda x: total[x])
        none = not langid.words(t or "")
        out[i] = ("und" if none else best, held[i], 0.0 if none else 1 / sum(math.exp(v - total[best]) for v in total.values()))
    return out


def test_language_of_awkward_rows(spark):
    docs = awkward(spark)
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (3, 4, 5, 8) or (r.doc_id is None and r.score == 0))
    assert langid.identify(empty(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_unseen_words_back_off_to_ngrams():
    items = [["aa", "bb"], ["2^a", "1a", "1b"]]
    scores = [np.array([[9, 1], [1, 9]]), np.array([[-5, -50], [-6, -60], [-70, -7]])]
    model = langid.Model(["x", "y"], items, scores)
    assert model.sums("ac") == [-5, -50] and model.sums("cb") == [-70, -7] and model.sums("12 .") is None
    assert model.sums("aa bb bb") == [11, 19] and model.sums("cba") == [-38, -34] and model.sums("q aa") == [9, 1]


def test_licences_under_titles_wrapped_and_inside(spark):
    texts = dict(reversed(licence_texts.LICENCES))
    mit, header = texts["MIT"], next(t for n, t in licence_texts.LICENCES if n == "Apache-2.0" and "\n" in t)
    wrapped = "\n\n".join(textwrap.fill(b, 40) for b in mit.split("\n\n"))
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 X\n\n" + mit),
        (2, "The MIT License (MIT)\nCopyright (c) Acme Corp\n" + wrapped),
        (3, "Some prose here.\n\nReleased under the\nMIT License.\n\nMore."),
        (4, "Copyright 2020 X\n\n" + "\n\n".join(textwrap.fill(b, 50) for b in header.split("\n\n")) + "\n\nOther text."),
        (5, "A tool.\n\n" + wrapped + "\n\n\n \nAnd more prose."),
        (6, "BSD 3-Clause License\n\nCopyright (c) The Regents\nAll rights reserved.\n\n" + texts["BSD-3-Clause"]),
        (7, mit.split("\n\n")[0]),
        (8, "copyright notice and this permission notice"),
    ]
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == ("MIT", "MIT") and got[3] == (None, "MIT") and got[4][1] == "Apache-2.0"
    assert got[5] == (None, "MIT") and got[6] == ("BSD-3-Clause", "BSD-3-Clause") and got[7] == got[8] == (None, "")
    own = spark.createDataFrame([("Own", "One two.\n\nThree\nfour."), (None, "x")], "licence string, text string")
    docs = spark.createDataFrame([(1, "a\n\nONE, two\n\n\nthree four\n\nb"), (2, "one two"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.notices for r in licences.scan(docs, own).collect()} == {1: "Own", 2: "", 3: ""}


def test_whole_texts_of_publishers(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    files = {"GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPL-3.0": "LGPL-3", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = {name: (folder / f).read_text() for name, f in files.items() if (folder / f).exists()}
    if not found:
        pytest.skip("no licence files here")
    rows = [(n, t.replace("\n", "\r\n").upper()) for n, t in found.items()]
    docs = spark.createDataFrame(rows, "name string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    got = {r.doc_id: r.licence for r in licences.scan(docs).collect()}
    assert [got[r.doc_id] for r in docs.collect()] == [r.name for r in docs.collect()]
    assert len({d for _, d in licence_texts.WHOLE_DIGESTS}) == len(licence_texts.WHOLE_DIGESTS)


def test_licences_in_other_dress(spark):
    mit, notice = dict(reversed(licence_texts.LICENCES))["MIT"], "Licensed under CC BY-NC 4.0."
    rows = [
        (1, "Copyright (c) 2019 Someone Else\n\n" + mit.upper().replace("\n", "\r\n")),
        (2, mit.replace("sublicense", "sub-license").replace("noninfringement", "non-infringement").replace(" ", "  ")),
        (3, mit + " And more."),
        (4, f"Some prose.\n{notice}\nMore prose, RELEASED UNDER THE MIT LICENCE\nReleased under the MIT licence!"),
        (5, notice),
        (6, None),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licence for i in range(1, 7)] == ["MIT", "MIT", None, None, "CC-BY-NC-4.0", None]
    assert got[4].notices == "CC-BY-NC-4.0,MIT" and got[4].n_notices == 2 and got[6].n_notices == 0
    own = spark.createDataFrame([("ours", "Our own terms."), ("ours", None), (None, "x")], "licence string, text string")
    extra = spark.createDataFrame([(1, "our OWN terms"), (2, "")], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licences.scan(extra, own).collect()} == {1: "ours", 2: None}


def test_licences_of_tables(spark):
    docs = awkward(spark)
    assert licences.scan(docs).count() == docs.count()
    assert licences.scan(empty(spark)).count() == 0
    plan = licences.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def area(score, y):
    rank = pd.Series(score).rank().to_numpy()
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / ones / (len(y) - ones)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    y = held.quality.to_numpy()
    assert area(held.score, y) > 0.99
    assert held.predicted[y == 1].mean() > 0.99 and held.predicted[y == 0].mean() < 0.1


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score_quality(empty(spark), labels).count() == 0
    none = quality.score_quality(docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.good_documents(docs, labels.limit(0)).columns == docs.columns


def test_forest_walk_equals_node_by_node():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(500, 6)), rng.integers(0, 2, 500).astype(float)
    forest = quality.fit(x, y)
    inner, leaves = 2**forest.depth - 1, 2**forest.depth
    for row, score in zip(x[:20], forest.score(x[:20]), strict=True):
        total = forest.base
        for t in range(len(forest.leaf) // leaves):
            node = 0
            while node < inner:
                node = 2 * node + 1 + (row[forest.feature[t * inner + node]] > forest.cut[t * inner + node])
            total += forest.leaf[t * leaves + node - inner]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def plain_statistics(text):
    """The statistics one by one, from the text as characters."""
    out = dict.fromkeys(quality.FEATURES, 0.0)
    raw = text.encode()
    n = len(raw)
    if not n:
        return out
    words, lines = text.split(), text.split("\n")
    letter = sum(b >= 128 or chr(b).isalpha() for b in raw)
    upper = sum(65 <= b < 91 for b in raw)
    sign = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    out |= {
        "log_bytes": math.log1p(n), "log_words": math.log1p(len(words)), "word_bytes": n / (len(words) + 1), "letter_share": letter / n,
        "digit_share": sum(chr(b) in "0123456789" for b in raw) / n, "upper_share": upper / (letter + 1), "symbol_share": sum(map(sign, raw)) / n,
        "end_share": sum(chr(b) in ".,;:?" for b in raw) / n, "other_byte_share": sum(b >= 128 for b in raw) / n,
        **{f"share_{ord(c)}": raw.count(c.encode()) / n for c in quality.SIGNS},
    }
    parts = raw.split(b"\n")
    parts = [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    noise = [sum(map(sign, p)) / (len(p) + 8) for p in parts]
    out |= {
        "log_lines": math.log1p(len(parts)), "line_words": len(words) / len(parts), "distinct_lines": len(set(lines)) / len(lines),
        "worst_line_symbols": max(noise), "worst_line_upper": max(sum(65 <= b < 91 for b in p) / (len(p) + 8) for p in parts), "noisy_lines": sum(x > 0.12 for x in noise) / len(noise),
    }
    if words:
        top = sorted(Counter(words).values(), reverse=True)
        triples = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
        out |= {
            "distinct_words": len(set(words)) / len(words), "top_word": top[0] / len(words), "top_words": sum(top[:5]) / len(words),
            "doubled_words": sum(a == b for a, b in zip(words, words[1:])) / len(words), "distinct_triples": len(triples) / max(1, len(words) - 2),
            "short_words": sum(len(w) <= 3 for w in words) / len(words), "signed_words": sum(not w[-1].isalnum() for w in words) / len(words),
        }
    return out | {"compression": len(zlib.compress(raw, 1)) / n}


def test_statistics_equal_plain_counts():
    rng = random.Random(2)
    texts = ["", " ", "\n", "a", "é\n\nÉ ß!", "A! b? 12 12 12"] + ["".join(rng.choice("abC  1é.,!#$\n漢_~") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    got = quality.statistics(texts)
    for row, text in zip(got, texts, strict=True):
        assert dict(zip(quality.FEATURES, row)) == pytest.approx(plain_statistics(text)), repr(text)


def plain_fit(x, y):
    """The same boosting node by node: every cut of every feature is tried on the rows of the node."""
    base = math.log((y.sum() + 0.5) / (len(y) + 1) / (1 - (y.sum() + 0.5) / (len(y) + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    margin = np.full(len(y), base)
    for _ in range(quality.ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        nodes = [np.arange(len(y))]
        for _ in range(quality.DEPTH):
            halves = []
            for at in nodes:
                best, side = 1e-9, np.ones(len(at), bool)
                for f, c in enumerate(cuts):
                    for cut in c:
                        left = x[at, f] <= cut
                        a, b = at[left], at[~left]
                        if len(a) and len(b) and min(h[a].sum(), h[b].sum()) >= quality.LEAST_WEIGHT:
                            gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE) * w for s, w in ((a, 1), (b, 1), (at, -1)))
                            if gain > best * (1 + 1e-9):
                                best, side = gain, left
                halves += [at[side], at[~side]]
            nodes = halves
        for at in nodes:
            if len(at):
                margin[at] -= quality.RATE * g[at].sum() / (h[at].sum() + quality.RIDGE)
    return 1 / (1 + np.exp(-margin))


def test_fit_equals_boosting_node_by_node(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 5)
    monkeypatch.setattr(quality, "DEPTH", 3)
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=200), rng.integers(0, 5, 200), rng.random(200)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 2) ^ (rng.random(200) < 0.1)).astype(float)
    assert quality.fit(x, y).score(x) == pytest.approx(plain_fit(x, y), abs=1e-9)


def test_unseen_words_send_only_ngrams_that_can_count(spark):
    """Below a length with a known n-gram none counts, so none is sent to the owners of n-grams."""
    sent = list(langid.pieces("abcde", {"4abcd": 0, "2ab": 1}))
    assert sent == [(4, f"4{g}") for g in langid.grams("abcde", 4)]
    every = [(n, f"{n}{g}") for n in (4, 3, 2, 1) for g in langid.grams("abcde", n)]
    assert list(langid.pieces("abcde", {})) == every
    assert list(langid.pieces("abcde", {"1a": 0})) == every
