"""Small tables with odd rows, written where a query can read them."""

from __future__ import annotations

import random

ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, target string, _row string, slot int"


def sentence(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 7))) for _ in range(n))


def odd_documents() -> list[tuple]:
    """Null and empty texts, blanks only, a very long text, copies, near copies, ties, odd characters, null sources."""
    base = sentence(1, 120)
    words = base.split(" ")
    near = [" ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(5, 115, 10)]
    texts = [
        None, "", " \n\t ", "one", "Two words", "two WORDS", base, base, base.upper(), *near,
        sentence(2, 9000), "line of words here\n" * 40, "a b c " * 60, sentence(3, 70) + " ### $$$ %%% " * 30,
        "Ünï cödé ßtraße 漢字 \U0001f642  x y " + sentence(4, 60), "<|endoftext|> in " + sentence(5, 55), "a  b\n c \r\n d",
        *[sentence(100 + k, 80 + 7 * k) for k in range(12)], *[sentence(7, 64)] * 6, "tail blank ", " head blank",
    ]
    sources = ["web", None, "", "é", "web", "web"]
    return [(1000 - 3 * k, text, sources[k % len(sources)]) for k, text in enumerate(texts)]


def write_documents(spark, folder: str, rows: list[tuple]) -> str:
    full = [(doc, text, "en", source, len(text or ""), 5, "x", "y", 6) for doc, text, source in rows]
    spark.createDataFrame(full, ODD_SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return folder


def write_pages(spark, folder: str, rows: list[tuple]) -> str:
    full = [(page, url, html, "z", 1) for page, url, html in rows]
    spark.createDataFrame(full, "page_id bigint, url string, html string, key string, offset int").repartition(3).write.mode(
        "overwrite"
    ).parquet(f"{folder}/pages.parquet")
    return folder


def write_conversations(spark, folder: str, rows: list[tuple]) -> str:
    full = [(*row, "z") for row in rows]
    spark.createDataFrame(full, "conv_id bigint, turn bigint, role string, text string, path_id string").repartition(3).write.mode(
        "overwrite"
    ).parquet(f"{folder}/conversations.parquet")
    return folder


def write_benchmark(spark, folder: str, rows: list[tuple]) -> str:
    full = [(item, text, 7, 8) for item, text in rows]
    spark.createDataFrame(full, "item_id bigint, text string, doc_id bigint, rank int").repartition(2).write.mode("overwrite").parquet(
        f"{folder}/benchmark.parquet"
    )
    return folder
