import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertweave.llm import packing, stuffing, tokens


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", "  ", "Hello world", "El niño ¿qué?", "<|endoftext|>", "a b\tc\r\n\n d", "0123456789 " * 40, "日本語 😀😀", "\x00\x07", "x" * 30_000, " " * 500 + "end", "it's we'll I'D"]


def test_ids_equal_the_public_encoder(spark, public):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    out = tokens.encoded(df)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got == {i: public.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.t for r in out.select("doc_id", tokens.text_of(F.col("ids")).alias("t")).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encoded(df.limit(0)).count() == 0


def test_random_texts(public):
    rng, e = random.Random(3), tokens.encoder(tokens.vocabulary_path())
    for _ in range(500):
        t = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x2FFF), rng.randrange(0x1F300, 0x1F6FF), 32, 10])) for _ in range(rng.randrange(1, 50)))
        ids = e.encode_batch([t])[0]
        assert ids == public.encode_ordinary(t) and e.decode(ids) == t


def test_containers(spark):
    rng = random.Random(1)
    texts = [None, "", "word " * 5000, *(f"alert {i} " * rng.randint(1, 300) for i in range(300)), *["same text again"] * 200]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, v string")
    out = packing.containers(df, 512).toPandas()
    sizes = dict(df.select("doc_id", tokens.count_of(F.col("text")).alias("n")).toPandas().itertuples(index=False, name=None))
    assert out.groupby("container_id")["n_tokens"].sum().max() <= 512
    assert out.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes
    for doc, pieces in out.groupby("doc_id"):
        assert len(pieces) == max(1, -(-sizes[doc] // 512)) and sorted(pieces["piece"]) == list(range(len(pieces)))
    filled = packing.fill_report(packing.containers(df, 512), 512).first()
    assert filled.filled > 0.98 and filled.n_items == len(out)
    assert packing.containers(df.limit(0)).count() == 0
    assert packing.fill_report(packing.containers(df.limit(0))).first().n_containers == 0


def test_hilbert_neighbours_are_adjacent_cells():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


NOTE = "The account was locked after three attempts and the user called us from the office in the morning. We closed the case because the sensor was late."
SPAM = [
    "Buy vpn here. Cheap vpn! Our vpn is the best vpn. " * 12,
    ", ".join(f"{a} vpn {b}" for a in ("cheap", "best", "free") for b in ("online", "offer", "price", "trial")),
    "\n".join(f"- [cheap vpn {i}](https://shop{i}.example/buy)" for i in range(30)),
    "\n".join(f"Tags: vpn; cheap; backup; best; offer {i}" for i in range(12)),
    NOTE[:89] + ".\n\n" + " | ".join(f"best backup {x}" for x in ("cheap", "free", "online", "offer", "price", "trial", "review", "download", "buy") * 6),
]
GOOD = [NOTE, NOTE + "\nIndicators:\n" + "\n".join(f"- 10.0.0.{i}" for i in range(60)), "\n".join(f"https://wiki.example/{i}: The {n} rule was raised after the update of the sensor and we told the owner about it." for i, n in enumerate(("first", "second", "third", "last"))), None, "", "   ", "ok"]


def test_stuffed_pages(spark):
    pages = [(i, t, f"host{i % 4}") for i, t in enumerate(SPAM + GOOD)] + [(100, SPAM[0], None), (101, SPAM[0], "host9")]
    df = spark.createDataFrame(pages, "doc_id bigint, text string, source string").withColumn("host", F.lit("clash")).withColumn("phrases", F.lit(1))
    assert {r.doc_id for r in stuffing.found(df).collect()} == {*range(len(SPAM)), 100, 101}
    scores = {r.doc_id: r for r in stuffing.scored(df).collect()}
    assert len(scores) == len(pages) and scores[0].score == scores[100].score == scores[101].score
    assert all(scores[len(SPAM) + i].score == 0 for i in (3, 4, 5))
    assert stuffing.found(df.limit(0)).count() == 0


def test_phrases_count_distinct_hosts(spark):
    p = spark.createDataFrame([("a", [1, 2], 1.0), ("a", [1], 0.0), ("b", [1, 3], 0.5), ("c", [1, 3], 0.0), (None, [3], 1.0)], "host string, phrases array<bigint>, list_density double")
    assert {(r.phrase, round(r.phrase_density, 6)) for r in stuffing.replicated(p, 3).collect()} == {(1, round(1 / 3, 6))}
    assert {r.phrase for r in stuffing.replicated(p, 2).collect()} == {1, 3}


OTHER_LANGUAGES = [
    "Пользователь позвонил утром и сказал, что не может войти в систему. Мы проверили журнал и сбросили пароль. После этого вход снова заработал, поэтому мы закрыли заявку.",
    "Użytkownik zadzwonił rano i powiedział, że nie może się zalogować. Sprawdziliśmy dziennik i zmieniliśmy hasło. Potem logowanie znowu działało, więc zamknęliśmy zgłoszenie.",
    "De gebruiker belde vanochtend dat hij niet kon inloggen. We hebben het logboek bekeken en het wachtwoord gewijzigd. Daarna werkte alles weer en is de melding gesloten.",
    "O utilizador ligou de manhã porque não conseguia entrar no sistema. Verificámos o registo e mudámos a palavra-passe. Depois disso tudo voltou a funcionar e fechámos o caso.",
    "The user called this morning and\nsaid that the mail client asks for\na password again and again. We looked into\nthe log of the server and found nothing\nthat explains it so far.",
]
STUFFED = "buy the best vpn for the cheap and the fast vpn in the world of the vpn deals for the vpn user and the vpn price of the best vpn in the vpn shop with the vpn offer of the day"


def test_no_language_is_a_list_and_function_words_are_no_alibi(spark):
    texts = [*OTHER_LANGUAGES, STUFFED, (STUFFED + ". ") * 4, "a." * 40_000, "<" * 40_000]
    df = spark.createDataFrame([(i, t, f"host{i}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    scores = {r.doc_id: r.score for r in stuffing.scored(df).collect()}
    assert all(scores[i] < 0.2 for i in range(len(OTHER_LANGUAGES)))
    assert {r.doc_id for r in stuffing.found(df).collect()} >= {5, 6} and not {0, 1, 2, 3, 4} & {r.doc_id for r in stuffing.found(df).collect()}


def test_replicated_phrases_decide(spark):
    """Pages stitched from phrases of full lists are cases, whatever their punctuation; lists of what notes quote are none."""
    word = lambda i: "".join("abcdefghij"[int(c)] + "o" for c in str(100 + i))
    junk = [f"cheap vpn offer for {word(i)} with a free backup of {word(i + 40)}" for i in range(12)]
    quoted = [f"failed logon of {word(i)} from the gateway to port {word(i + 40)}" for i in range(50, 62)]
    note = " ".join(f"{word(i).capitalize()} {word(7 * i)} was {word(3 * i)} by {word(5 * i + 1)} after {word(2 * i)} had {word(9 * i)}." for i in range(100, 140))
    lists = [("\n".join(junk), h) for h in "abcdefgh"]
    notes = [(note + "\n" + "\n".join(quoted), h) for h in "abcdefgh"]
    stitched = (". ".join(x.capitalize() for x in junk) + ".", "i")  # written as sentences, from phrases of the lists
    quote = ("\n".join(quoted), "j")  # a list by itself, of lines that notes quote
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate([*lists, *notes, stitched, quote])], "doc_id bigint, text string, source string")
    scores = {r.doc_id: r for r in stuffing.scored(df).collect()}
    assert scores[16].list_density < stuffing.SCORE and scores[17].list_density > 0.9
    flagged = lambda hosts: {r.doc_id for r in stuffing.scored(df, hosts).collect() if r.score >= stuffing.SCORE}
    assert flagged(3) == {*range(8), 16}
    assert flagged(1000) == {*range(8), 17}  # without the phrases the structure errs on both
