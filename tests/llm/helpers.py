"""Small corpora with the odd cases that every operator has to stand."""

from pyspark.sql import functions as F

WORDS = "river stone cloud window garden paper silver morning winter letter bridge candle forest mirror harbor meadow copper thunder pillow basket lantern marble orchard saddle velvet walnut anchor blanket cactus dolphin ember falcon glacier hammer island jacket kettle ladder magnet needle".split()


def prose(seed: int, n: int) -> str:
    import random

    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "s", "ed", "ing"]) + str(draw.randint(0, 9)) for _ in range(n))


def thue_morse(size=1024):
    """Two words of a and b that every polynomial hash modulo 2**64 with an odd base takes for one."""
    bits = [k.bit_count() & 1 for k in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def odd_rows():
    """(doc_id, text, lang, source): nulls, blanks, long texts, ties, repeats, near copies, shared passages, words that weak hashes confuse."""
    base, passage = prose(1, 120), prose(2, 60)
    one, other = thue_morse()
    around = prose(9, 30), prose(10, 20)
    return [
        (1, base, "en", "src0"), (2, base, "en", "src0"), (3, base.replace("stone", "stoned"), "en", "src0"), (4, None, "en", "src1"), (5, "", None, None), (6, " \n\t ", "de", "src1"),
        (7, "one two three", "en", "src1"), (8, "one two three", "en", "src1"), (9, "ONE  two\nthree", "en", "src1"), (10, prose(3, 30) + " " + passage + " " + prose(4, 30), "fr", "src2"), (11, passage + " " + prose(5, 50), "es", "src2"),
        (12, "same " * 400, "en", "src2"), (13, prose(6, 20_000), "en", "src3"), (14, "x" * 200_000, "en", "src3"), (15, "été déjà vu " * 30, "fr", "src3"), (15, prose(7, 70), "fr", "src3"), (15, prose(7, 70), "fr", "src3"), (None, base, "en", "src0"), (16, prose(8, 80), "en", "src4"),
        (17, one, "en", "src4"), (18, other, "en", "src4"), (19, f"{around[0]} {one} {around[1]}", "en", "src4"), (20, f"{around[0]} {other} {around[1]}", "en", "src4"),
    ]


def documents(spark, rows=None):
    """The odd rows, or others, with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(odd_rows() if rows is None else rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for name in ("n_words", "kept", "sig", "n", "start", "end", "key", "component", "mix_p", "rid", "packed", "pos", "quality", "a", "b"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def empty(spark):
    return documents(spark).limit(0)


def words(text):
    return (text or "").encode().split()
