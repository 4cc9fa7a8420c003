import random
import re
import unicodedata

import numpy as np
import pytest

from quarrygraph.llm import charstats as C

LABELS = ["junk", "table", "list", "prose"]
COMMON = C.Common(["the", "and"], ["我们", "的"])
MODEL = C.LineModel(LABELS).ready()


def figures(texts, wanted=None):
    return C.features(texts, COMMON, MODEL, LABELS, wanted)


def some_texts(n, seed=3):
    r = random.Random(seed)
    pool = "abcdeXYZé 0123  .,;:!?\n\n\t|-(){}我们的图\"'’*� "
    return ["".join(r.choice(pool) for _ in range(r.randrange(0, 200))) for _ in range(n)]


def test_against_plain_python():
    texts = [*some_texts(60), "The cat, and THE dog.\n\nno end", "我们的 map!", "", " \n\t", "a\r\nb.\rc", "x" * 5000, "it's"]
    got = figures(texts)
    for i, raw in enumerate(texts):
        t = raw.replace("\r\n", "\n").replace("\r", "\n")
        lines = [x for x in t.split("\n") if x.strip()]
        assert got["lines"][i] == len(lines)
        size = sum(map(len, lines))
        assert got["mean_line_length"][i] == pytest.approx(size / len(lines) if lines else 0)
        assert got["tab_lines"][i] == pytest.approx(sum(len(x) for x in lines if "\t" in x) / size if lines else 0)
        assert got["line_kinds"][i] == pytest.approx(len({x.lower() for x in lines}) / len(lines) if lines else 1)
        seen = [c for c in t if not c.isspace()]
        share = lambda f: sum(map(f, seen)) / len(seen) if seen else 0
        assert got["digit_share"][i] == pytest.approx(share(lambda c: unicodedata.category(c)[0] == "N"))
        assert got["upper_share"][i] == pytest.approx(share(str.isupper))
        assert got["han_share"][i] == pytest.approx(share(lambda c: "一" <= c <= "鿿"))
        words = re.findall(r"[一-鿿]|(?:(?![一-鿿])[^\W\d_]['’]?|\d)+", t)
        assert got["words"][i] == len(words)
        common = sum(w.lower() in ("the", "and") for w in words) + sum(map(len, re.findall("我们|的", t)))
        assert got["common_share"][i] == pytest.approx(common / len(words) if words else 0)
    assert all(np.isfinite(v).all() for v in got.values())


def test_batches_and_choices_do_not_matter():
    texts = some_texts(30)
    whole = figures(texts)
    for i, t in enumerate(texts):
        one = figures([t])
        assert all(one[k][0] == pytest.approx(whole[k][i], abs=1e-9) for k in whole)
    for k in whole:
        assert np.array_equal(figures(texts, frozenset([k]))[k], whole[k])
    assert set(figures([])) == set(whole)


def test_repetition_and_regularity():
    got = figures(["a b c d. " * 50, "one two three four five six seven eight nine", "\n".join(f"k{i},{i},x" for i in range(9)), "\n".join("," * (i % 5) + "x" for i in range(9))])
    assert got["phrase_kinds"][0] < 0.1 and got["phrase_kinds"][1] == 1
    assert got["alike_comma_lines"][2] == 1 and got["alike_comma_lines"][3] < 0.5


def test_line_model_tells_labelled_shapes_apart():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    make = [lambda: "".join(r.choice("{}<>;=$#@") for _ in range(60)), lambda: "\n".join(f"{word()}\t{r.randrange(99)}" for _ in range(6)), lambda: "\n".join(f"- {word()}" for _ in range(6)), lambda: " ".join(f"{word()} {word()}, {word()}." for _ in range(8))]
    label = np.arange(80) % 4
    model = C.LineModel(LABELS)
    model.add(C.batch([make[k]() for k in label]), label)
    got = C.features([make[k]() for k in range(4)], COMMON, model.ready(), LABELS)
    assert [int(np.argmax([got[f"{x}_like_lines"][i] for x in LABELS])) for i in range(4)] == [0, 1, 2, 3]


def test_chunks():
    assert C.chunks([]) == [] and C.chunks(["a"]) == [(0, 1)]
    big = "x" * (C.CHUNK + 5)
    assert C.chunks(["a", big, "b", "c"]) == [(0, 1), (1, 2), (2, 4)]
