import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

    def make(rows, kind="doc_id long, text string"):
        return spark.createDataFrame(rows, kind)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def awkward(frame):
    long = " ".join(WORDS[(i * i + 3 * i) % len(WORDS)] + str(i % 97) for i in range(30_000))
    base = " ".join(f"{WORDS[i % 19]}{i}" for i in range(60))
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "Same text"), (5, "sAME TEXT"), (5, "sAME TEXT"), (None, "same text"), (6, "ÉTÉ"),
        (7, "été"), (8, long), (9, long + " end"), (10, base), (11, base.replace("beta1 ", "other ")), (12, base.upper()), (13, "one"),
        (14, "one two"), (15, "a<|endoftext|>b <|endoftext|>"), (16, "x  y \n z q's 12 ½ é Ω漢字 😀!!"), (17, " lead and trail "),
        (18, "MIT License; Apache License\nSPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 WITH LLVM-exception"),
        (19, "H̱ İ Σ don't DON'T"), (20, "tab\there new\n\nline"), (None, None),
    ]
    clash = "doc_id long, text string, id long, row long, label int, slot int, rate double, digest string, n_chars long, `a.b` int"
    return frame([(i, t, 0, 0, 0, 0, 0.0, "d", None if t is None else len(t), 1) for i, t in rows], clash)
