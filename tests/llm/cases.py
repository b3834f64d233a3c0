"""Texts and tables that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words):
    r = random.Random(seed)
    syllables = ["ta", "re", "mi", "no", "ku", "sé", "lo", "Pa", "ti", "on"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(words))


def rows():
    base = prose(1, 300)
    near = base.replace(base.split()[150], "changed", 1)
    texts = {
        0: base, 1: base, 2: near, 3: base.upper(), 4: None, 5: "", 6: " \n\t ", 7: "one two", 8: "one two", 9: "one two three four five",
        10: "ONE two three four five", 11: prose(2, 120), 12: prose(2, 120) + " tail", 13: "\n".join(["same line of words here"] * 40),
        14: prose(3, 60) + " " + base + " " + prose(4, 60), 15: "a b c d\x0be\x0cf " + prose(5, 80), 16: "日本語 テキスト 😀 " * 30,
        17: prose(6, 30_000), 18: "x" * 200_000, 19: "1" * 50_000 + "@" * 5_000, 20: "the " * 400, 21: "ends with spaces   ", 22: "'s 't 'll  it's\r\n\r\n  x",
        23: "<|endoftext|> ordinary <|startoftext|>", 24: "İstanbul ΣΑΣ é ﬁ ​",
    }
    out = [(i, t, "en" if i % 3 else "de", f"src{i % 4}" if i != 11 else None, len(t or "")) for i, t in texts.items()]
    out.append(out[0])  # a repeated row
    out.append((None, base, None, "src1", 5))
    return out


def documents(spark):
    """With extra columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    more = {"uid": F.lit("x"), "name": F.lit(1), "node": F.lit(2.5), "size": F.lit(None).cast("string")}
    names = ("level_0", "whole", "partial", "plan", "__key", "__rules", "__kept", "__place", "block", "owner", "least", "Text_md5", "place", "epochs", "list")
    return df.withColumns(more | {n: F.lit(n) for n in names})


def empty(spark):
    return documents(spark).filter("false")
