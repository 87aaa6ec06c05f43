import pytest

WORDS = "the of and to in is that for with as river stone light green house water".split()
GERMAN = "der die und das nicht ein mit schule straße über haus wasser grün licht".split()


def prose(k: int, n: int, words=WORDS) -> str:
    return " ".join(words[(k * 7 + i * i + i * (k % 5 + 1)) % len(words)] for i in range(n))


def texts() -> list[tuple]:
    """doc_id, text, lang, source with nulls, empty and very long texts, ties and repeated rows."""
    out = [(i, prose(i, 30 + i % 17) + f" token{i}.", "en", f"s{i % 3}") for i in range(60)]
    out += [(i, prose(i, 40, GERMAN) + ".", "de", "s1") for i in range(60, 110)]
    out += [(110, None, "en", "s1"), (111, "", None, None), (112, " \t\n", "en", "s1"), (113, "12345 678 !!", "en", "s2"), (114, "short text", "en", "s2")]
    out += [(115, prose(3, 60_000), "en", "s0"), (116, out[5][1], "en", "s2"), (117, out[5][1].upper(), "en", "s2"), (118, "short  text", "en", "s2"), (119, "short text", "de", "s2")]
    out += [out[7], out[7]]  # repeated rows
    out += [(None, "a row without an id stands here", "en", "s1"), (120, "é" * 50 + " 日本語 " + "x" * 3000, "fr", "s1")]
    long = prose(2, 400).split()
    for k in range(12):  # near copies: every copy differs in a few places
        w = list(long)
        for j in range(4):
            w[(k * 31 + j * 97) % 400] = f"edit{k}x{j}"
        out.append((200 + k, " ".join(w), "en", "s0"))
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    # further columns whose names the operators use themselves
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("key", "h", "n", "score", "codes", "findings", "spans", "x", "op", "label", "sid", "lang_pred")})


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
