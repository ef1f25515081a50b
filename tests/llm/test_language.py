import random
import zlib

import numpy as np
from shelfwise.llm import byte_cnn
from shelfwise.llm.batches import renamed


def corpus(n=240):
    pick = random.Random(4)
    parts = {"aa": ["tor", "ing", "the", "sh"], "bb": ["ßen", "üch", "der", "ung"], "cc": ["ción", "ñez", "que", "ado"]}
    rows = []
    for i in range(n):
        lang = pick.choice(list(parts))
        rows.append((i, " ".join("".join(pick.choices(parts[lang], k=3)) for _ in range(pick.randint(5, 400))), lang))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", None), (None, "üchßen derung", "aa"), (3, "tor ing the", None), (1003, "ñez " * 50_000, "cc")]
    docs = spark.createDataFrame([(a, b, c, 5, "x") for a, b, c in rows + odd], "doc_id long, text string, lang string, score int, lang_pred string")
    network = byte_cnn.fit(docs, docs_per_lang=40, epochs=12)
    got = byte_cnn.predict(docs.select("doc_id", "text", "lang", "lang_pred"), network).select("c0", "c1", "c2", "c3", "lang_pred", "score", byte_cnn.held_out("c0").alias("out")).collect()
    assert len(got) == len(rows) + len(odd)
    checked = [r for r in got if r.out and r.c0 is not None and r.c0 < 1000]
    assert len(checked) > 20 and np.mean([r.lang_pred == r.c2 for r in checked]) > 0.98
    assert all(r.out == (r.c0 is None or zlib.crc32(str(r.c0).encode()) % 5 == 0) for r in got)
    und = {r.c0 for r in got if r.lang_pred == "und"}
    assert und == {1000, 1001, 1002} and all(r.score == 0 for r in got if r.c0 in und)
    assert all(0 <= r.score <= 1 for r in got) and next(r for r in got if r.c0 == 1003).lang_pred == "cc"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert byte_cnn.fit(docs) is None
    row = renamed(byte_cnn.predict(docs, None), docs.columns, "lang_pred", "score").first()
    assert (row.doc_id, row.lang_pred, row.score) == (1, "und", 0.0)
    assert byte_cnn.predict(docs.limit(0), None).count() == 0


def test_windows_cover_every_ngram_of_the_whole_text():
    text = "".join(random.Random(2).choices("abcdefgh", k=2000))
    windows = byte_cnn.windows_of(text)
    raw = (" " + text + " ").encode().translate(byte_cnn._CLASS)
    seen = {bytes(w[i:i + 4]) for w in windows for i in range(byte_cnn.WINDOW - 3)}
    assert {raw[i:i + 4] for i in range(len(raw) - 3)} <= seen
