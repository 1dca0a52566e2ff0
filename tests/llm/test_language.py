from turnwise.llm.language import fit_filters, identify_languages
from turnwise.llm.lexicon import label_lang, spoken_words

SAMPLES = {
    "en": ["the old teacher reads a long book about the sea every day", "we have seen that the water is cold in the winter", "nobody knows why the bridge was closed last year"],
    "it": ["il vecchio maestro legge un lungo libro sul mare ogni giorno", "abbiamo visto che l'acqua è fredda in inverno", "nessuno sa perché il ponte è stato chiuso l'anno scorso"],
    "ru": ["старый учитель читает длинную книгу о море каждый день", "мы видели что вода зимой холодная", "никто не знает почему мост закрыли в прошлом году"],
    "zh": ["老师每天都在读一本关于大海的长书", "我们已经看到冬天的水很冷", "没有人知道为什么去年这座桥关闭了"],
}


def filters():
    rows = [(lang, t) for lang, ts in SAMPLES.items() for t in ts for _ in range(12)]
    return fit_filters(rows + [("en", SAMPLES["it"][0]), ("zh", SAMPLES["ru"][1]), ("und", "x")])


def test_label_spellings():
    assert [label_lang(x) for x in ("IT", "it-IT", "italiano", "de_DE", "English", " fr ", "", None, "auto", "und", "zh-CN")] == ["it", "it", "it", "de", "en", "fr", None, None, None, None, "zh"]


def test_spoken_words_leave_clutter_out():
    assert spoken_words("[00:01:02] Speaker 2: uhm, <noise> (applause) hello *coughs* ♪♪ world 00:02:05,491") == ["hello", "world"]
    assert spoken_words("(…) ehm ♪ ♪ [music]") == [] and spoken_words(None) == []


def test_identify(spark):
    mixed = SAMPLES["it"][0] + ". " + SAMPLES["en"][0] + "."
    rows = [
        ("a", "it", SAMPLES["it"][1]), ("b", None, SAMPLES["en"][1]), ("c", "de", SAMPLES["ru"][2]), ("d", "ITA", mixed),
        ("e", "en", ""), ("f", "en", None), ("g", "en", "[music] uhm"), ("h", "zh", SAMPLES["zh"][0]), ("i", "en", "12 345"),
        ("j", "en", SAMPLES["en"][2] + ": «ponte chiuso»"), ("b", None, SAMPLES["en"][1]), ("k", "auto", "il ponte " * 40000), (None, "ru", SAMPLES["it"][2]),
        ("l", "en", "ჭერი კარი"),
    ]
    df = spark.createDataFrame(rows, "id string, lab string, body string")
    df = df.selectExpr("id", "lab", "body", "1 as text", "2 as lang", "3 as record_id")
    got = {(r["record_id"], r["lang"]) for r in identify_languages(df, "id", "lab", "body", filters(), cases_only=True).collect()}
    assert got == {("b", "en"), ("c", "ru"), ("d", "it"), ("d", "en"), ("k", "it"), (None, "it"), ("l", "und")}
    every = identify_languages(df, "id", "lab", "body", filters()).collect()
    assert {r["record_id"] for r in every} == {"a", "b", "c", "d", "h", "j", "k", "l", None} and all((r["confidence"] == 0) == (r["lang"] == "und") and r["confidence"] <= 1 for r in every)
    assert identify_languages(df.limit(0), "id", "lab", "body", filters()).count() == 0


def test_held_out_accuracy(spark):
    import glob

    path = "/root/testdata/sf0.01/transcript_chunks.parquet"
    if not glob.glob(path):
        return
    df = spark.read.parquet(path).dropDuplicates(["chunk_id"])
    from turnwise.llm.language import language_filters

    f = language_filters(df, "detected_language", "text")
    out = identify_languages(df, "chunk_id", "detected_language", "text", f).filter("is_main").collect()
    labelled = {r["chunk_id"]: label_lang(r["detected_language"]) for r in df.collect()}
    known = [r for r in out if labelled[r["record_id"]]]
    assert sum(labelled[r["record_id"]] == r["lang"] for r in known) > 0.8 * len(known)  # a tenth of the labels are wrong


def test_the_sample_is_bounded_and_moved_alone(spark):
    from turnwise.llm import language

    rows = [("it", SAMPLES["it"][0])] * 3000 + [(lang, f"{t} {i}") for lang, ts in SAMPLES.items() for t in ts for i in range(100)]
    df = spark.createDataFrame(rows, "l string, t string").repartition(8)
    f = language.language_filters(df, "l", "t", max_rows=200)
    who = language.Identifier(f)
    assert [language.LANGS[i] for i in who.main([SAMPLES["it"][0], SAMPLES["en"][1], SAMPLES["ru"][0]])[0]] == ["it", "en", "ru"]
    h = df.withColumn("h", language.F.xxhash64("l", "t"))
    assert h.filter(language.F.pmod("h", language.F.lit(1 << 30)) < int((1 << 30) * 1.1 * 200 / 1201)).select("h").distinct().count() < 330
