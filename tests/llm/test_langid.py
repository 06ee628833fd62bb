import random

from pyspark.sql import functions as F

from tests.llm.helpers import docs, rows
from twinseek.llm import langid, registry


def slow_phrases(train, text):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in train:
            k += 1
        i += k
        n += 1
    return n


def test_phrases_match_brute_force():
    r = random.Random(2)
    samples = {x: ["".join(r.choice(a) for _ in range(150)) for _ in range(4)] for x, a in (("aa", "abcab "), ("bb", "bcdde "), ("cc", "xyzé "))}
    long = "".join(r.choice("abcde ") for _ in range(5 * langid.PIECE))
    samples["dd"] = [long]
    model = langid.train(samples)
    joined = {x: [int(s) for t in ts for s in (*langid.symbols_of(model.symbol, t), langid.SPACE)] for x, ts in samples.items()}
    as_text = lambda s: "".join(map(chr, s))
    texts = ["".join(r.choice("abcdexyzéQ 1") for _ in range(n)) for n in (1, 7, 100, langid.PIECE, langid.PIECE + 1, 3 * langid.PIECE + 5)]
    # The end of a training text as a text is one phrase over many pieces.
    symbols = [s for s in (langid.symbols_of(model.symbol, t) for t in [*texts, long[11:]]) if len(s)]
    got = langid.phrases(model, symbols)
    for s, row in zip(symbols, got):
        assert row.tolist() == [slow_phrases(as_text(joined[x]), as_text(s)) for x in model.languages]
    assert got[-1][model.languages.index("dd")] == 1


SCRIPTS = {"en": "abcdefghijklmnopqrst", "el": "αβγδεζηθικλμνξοπρστυ", "ru": "абвгдежзийклмнопрсту", "he": "אבגדהוזחטיכלמנסעפצקרש", "ar": "ابتثجحخدذرزسشصضطظعغفق", "hi": "अआइईउऊएऐओऔकखगघचछजझटठ", "th": "กขคงจฉชซญดตถทธนบปผพฟ", "ka": "აბგდევზთიკლმნოპჟრსტუ", "hy": "աբգդեզէըթժիլխծկհձղճմ", "ko": "가나다라마바사아자차카타파하거너더러머버", "zh": "的一是不了人我在有他这中大来上个国到说们"}


def test_many_scripts_and_languages(spark):
    """Every language has the same share of the model however many there are, and no script lacks letters."""
    r = random.Random(4)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randrange(2, 7)))
    vocabulary = {f"{x}{k}": [word(a) for _ in range(60)] for x, a in SCRIPTS.items() for k in range(2)}  # two languages a script
    data = [(i, " ".join(r.choice(vocabulary[lang]) for _ in range(25)), lang, None, None) for i, lang in enumerate(sorted(vocabulary) * 24)]
    every = docs(spark, data)
    got = {x.doc_id: x.lang_pred for x in langid.identify(every.where("doc_id % 3 = 0"), every.where("doc_id % 3 <> 0")).collect()}
    assert sum(got[i] == data[i][2] for i in got) >= 0.95 * len(got) and len(got) > 150


def test_ties_repeats_and_clashing_columns(spark):
    learned = docs(spark, [(1, "abc abc abc", "xx", None, None), (2, "abc abc abc", "ww", None, None)])
    asked = docs(spark, [(7, "abc", None, None, None), (7, "abc", None, None, None)]).withColumns({"lang_pred": F.lit("?"), "score": F.lit(9), "rank": F.lit(1), "mark": F.lit("m")})
    got = langid.identify(asked, learned.withColumns({"mark": F.lit("m"), "rank": F.lit(0), "n": F.lit(1)}))
    assert got.columns == ["doc_id", "lang_pred", "score"] and [(x.doc_id, x.lang_pred, x.score) for x in got.collect()] == [(7, "ww", 0.5)] * 2


def test_sample_is_bounded(spark):
    few = langid.sample(docs(spark, [(i, "many words here " * 50, "en", None, None) for i in range(3000)] + [(None, "rare", "qq", None, None)]))
    assert len(few["en"]) == langid.SAMPLE_ROWS and {len(t) for t in few["en"]} == {langid.SAMPLE_CHARS} and few["qq"] == ["rare"]


def made(n=240, seed=1):
    r = random.Random(seed)
    syllables = {"en": "the ing an tion ", "de": "sch ung der ich ", "fr": "é eau le oux "}
    out = []
    for i in range(n):
        lang = r.choice(list(syllables))
        out.append((i, "".join(r.choice(syllables[lang].split(" ")[:-1]) + (" " if r.random() < 0.3 else "") for _ in range(60)), lang, None, None))
    return out


def test_held_out_accuracy_and_odd_rows(spark, tmp_path):
    data = made() + [(1000, None, "en", None, None), (1001, "", None, None, None), (1002, "12 !?", "de", None, None), (1003, "漢字", None, "s", 1), (1004, "the thing " * 60000, "fr", "s", 1), (1004, "the thing " * 60, "fr", "s", 1), (None, "der schung", None, None, None)]
    docs(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op5_cross_parsing(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    truth = {d[0]: d[2] for d in data[:240]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    odd = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert [odd[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and odd[1003].lang_pred in ("de", "en", "fr") and odd[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.op5_cross_parsing(spark, str(tmp_path)).collect() == []
    data = docs(spark, rows(["some text", None]))
    assert {r.lang_pred for r in langid.identify(data, data.where("false")).collect()} == {"und"}
