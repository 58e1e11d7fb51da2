import random

import pytest

from kgflow.llm import languages, sentences

NAMES = ["Korvax", "Belimar", "Tusodent", "Ramigol", "Pelican", "Dorvath"]
EN = ["The router {n} forwards packets to Dr. Miller at {k}.5 ms.", "Why does {n} drop frames, e.g. late ones?", "Each host keeps timers, counters, etc. for {n}!", "The clock was set at {k} p.m. by {n}.", 'The operator asked, "Is {n} up?" and then left.']
DE = ["Der Vermittler {n} verzögert die Pakete um {k} ms.", "Warum zählt {n} so viele Rahmen?", "Ohne {n} müsste jeder Rechner alles selbst speichern.", "Am {k}. März fiel {n} aus."]
ZH = ["当链路拥塞时，{n}会在{k}毫秒内检查数据包。", "为什么{n}仍然丢弃确认消息？", "学生问：“{n}还在运行吗？”然后关闭了网关。"]
RU = ["Почему {n} шифрует сегменты, если канал перегружен?", "Версия {k} отправляет пакеты, таймеры и т. д. на узел {n}.", "Без {n} каждому узлу пришлось бы хранить кадры."]
SETS = {"en": EN, "de": DE, "zh": ZH, "ru": RU}


def written(rng, lang, n):
    return [rng.choice(SETS[lang]).format(n=rng.choice(NAMES), k=rng.randrange(1, 28)) for _ in range(n)]


def joined(lang, parts):
    return ("" if lang == "zh" else " ").join(parts)


@pytest.fixture(scope="module")
def corpus():
    rng, docs = random.Random(8), []
    for i in range(700):
        lang = rng.choice(list(SETS))
        paragraphs = [written(rng, lang, rng.randrange(1, 5)) for _ in range(rng.randrange(1, 4))]
        docs.append((i, lang, paragraphs, "\n\n".join(joined(lang, p) for p in paragraphs)))
    return docs


def test_sentences_of_four_languages(spark, corpus):
    df = spark.createDataFrame([(i, t, l, 7) for i, l, _, t in corpus], "doc_id long, text string, lang string, start_at int")
    got = {}
    for r in sentences.sentences(df).collect():
        got.setdefault(r.doc_id, []).append((r.start_at, r.sentence))
    right = wrong = 0
    for i, _, paragraphs, text in corpus:
        want = [s for p in paragraphs for s in p]
        found = [s for _, s in sorted(got[i])]
        assert all(text[a : a + len(s)] == s for a, s in got[i])
        right += len(set(found) & set(want))
        wrong += len(set(found) - set(want))
    assert right / (right + wrong) > 0.99


def test_layout_rules():
    w = sentences.fit([], {})
    text = '\n Heading one\n\n- first item\n- "second"\nitem goes on\n\n  a line\nbroken once\r\n\r\nlast'
    assert [text[a:b] for a, b in sentences.split(text, w)] == ["Heading one", "first item", '"second"\nitem goes on', "a line\nbroken once", "last"]
    assert sentences.split("  \n ", w) == [] and sentences.split("", w) == []
    assert sentences.split("- ", w) == [] or [x for x in sentences.split("- ", w)]


def test_sentences_of_nothing_and_of_a_very_long_text(spark):
    schema = "doc_id long, text string, lang string"
    assert sentences.sentences(spark.createDataFrame([], schema)).collect() == []
    long = "The host sends frames. " * 20_000
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n", None), (4, long, "en"), (5, "No mark", None), (5, "No mark", None)]
    got = sentences.sentences(spark.createDataFrame(rows, schema)).collect()
    assert {r.doc_id for r in got} == {4, 5} and sum(r.doc_id == 5 for r in got) == 2 and max(r.end_at for r in got) == len(long.rstrip())


def test_labels_in_any_notation():
    got = [languages.code_of(x) for x in ["en", "EN_us", "eng", "German", "zh-Hans", "pt-BR", "Français", "und", "xx", "", None, "unknown", " ru "]]
    assert got == ["en", "en", "en", "de", "zh", "pt", "fr", None, None, None, None, None, "ru"]


def test_languages_of_plain_wrong_and_mixed_documents(spark, corpus):
    rng = random.Random(9)
    rows, want = [], {}
    for i, lang, _, text in corpus:
        label = lang if i % 10 else rng.choice(["en", "de", "nl", "", None, "und"])
        if i % 7 == 0:
            other = rng.choice([x for x in SETS if x != lang])
            text += "\n\n" + joined(other, written(rng, other, 2))
            want[i] = {lang, other}
        elif label != lang:
            want[i] = {lang}
        rows.append((i, text, label, 0.5))
    rows += [(9000, None, "en", 0.1), (9001, "", None, 0.1), (9002, "12 34 !", None, 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence double")
    got = {r.doc_id: set(r.languages) for r in languages.document_languages(df).collect() if r.is_case}
    same = sum(got.get(i) == s for i, s in want.items())
    assert same >= 0.98 * len(want) and len(set(got) - set(want)) <= 0.01 * len(rows)
    s = languages.language_stretches(df).filter("doc_id = 0").orderBy("stretch_no").collect()
    assert len({r.lang for r in s}) == 2 and all(r.confidence > 0.5 and r.start_at < r.end_at for r in s)


def test_languages_without_labels_and_of_nothing(spark):
    schema = "doc_id long, text string, lang string"
    assert languages.document_languages(spark.createDataFrame([], schema)).collect() == []
    got = languages.document_languages(spark.createDataFrame([(1, "some text here", None), (2, "other " * 30_000, "zz")], schema)).collect()
    assert {r.doc_id for r in got} == {1, 2} and all(r.is_case for r in got)


def test_texts_in_no_known_language_are_told(spark, corpus):
    other = [
        "한국어로 작성된 이 문서는 네트워크의 기본 개념을 설명하고 있으며 여러 장치가 어떻게 연결되는지 보여준다. 라우터는 패킷을 전달하고 스위치는 프레임을 보낸다.",
        "Sieć komputerowa składa się z wielu urządzeń, które wymieniają pakiety danych między sobą przez różne łącza fizyczne i bezprzewodowe.",
    ]
    rows = [(i, t, l) for i, l, _, t in corpus] + [(8000 + i, t, None) for i, t in enumerate(other)]
    got = {r.doc_id: r.languages for r in languages.document_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[8000 + i] == [languages.OTHER] for i in range(len(other)))
    assert not any(languages.OTHER in x for i, x in got.items() if i < 8000)


def test_labels_as_columns_are_read_alike(spark):
    labels = ["en", "EN_us", " eng ", "German", "zh-Hans", "pt-BR", "Français", "und", "xx", "", None, "unknown", " ru ", "中文(简体)", "-", "es/en"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, lang string").select("i", languages.code_column("lang").alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [languages.code_of(x) for x in labels]


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "The router forwards packets to the host.", None), (1, "The router forwards packets to the host.", "en"), (2, "Der Rechner sendet die Pakete an den Vermittler.", "de")]
    got = {r.doc_id: r.label for r in languages.document_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {1: "en", 2: "de"}
