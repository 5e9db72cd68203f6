"""The learned sentence splitter against hand-marked sentences, and the bytes of written splits."""

import glob
import random
import re

from pyspark.sql import functions as F

from quire.functions import extract as X
from quire.functions import patterns as P
from quire.sources import io as IO

# "|" marks where a sentence ends
MARKED = [
    "Xylella fastidiosa sp. nov. was found in Italy.| It infects olive trees, e.g. Olea europaea, at 3.5 degrees.| Dr. Rossi agrees!",
    "The loss was 2.75 per cent.| Was it real?| Mr. Smith and Dr. Jones of the U.S. Department say so.| See Fig. 3 and cf. Table 2.",
    "The value (approx. 4.2) rose.| \"It spreads,\" she said.| 1998 was worse.| J. R. Brown counted 12 sp. Nothing else was seen.",
    "M. Dupont a vu env. 30 arbres.| Le prof. Martin, p. ex. en Corse, l'a confirmé.| Était-ce vrai ?| Oui !",
    "Der Befall betrug ca. 3.5 Prozent.| Laut Dr. Weber sind z.B. Oliven betroffen.| Über 200 Bäume starben.| Vgl. Abb. 4 dazu.",
    "El Dr. García vio aprox. 40 árboles.| ¿Era verdad?| Sí, según la pág. 12 del informe.| Los daños crecieron un 2.5 por ciento.",
]
# what the words are learned from: no marks, the same kinds of abbreviations among ordinary ends
CORPUS = [t for i in range(60) for t in (
    f"Dr. Weber saw {i} trees. Mr. Lee saw more. Fig. {i} shows this, cf. table {i}. It was approx. {i} per cent of sp. {i} there.",
    f"M. Dupont a vu env. {i} arbres. Le prof. Martin, p. ex. ici, l'a dit. C'est vrai. La maladie progresse dans les arbres.",
    f"Dr. Weber zählte ca. {i} Bäume, z.B. Oliven. Vgl. Abb. {i} dazu. Die Bäume starben. Das war schlimm, e.g. in U.S. Orten.",
    f"El Dr. García vio aprox. {i} árboles en la pág. {i} del informe. Los árboles murieron. El informe lo dice. J. R. Brown nov. {i} ok.",
    "It was real. They say so. See the trees. The value rose. He agrees. It spreads. The trees died. Nothing else was seen there.",
    "the real value of trees and what they say so that it rose and agrees with reports that all trees died when it spreads",
    "dazu viele bäume die starben als schlimm; vrai que les arbres dit ici; los árboles murieron y dice el informe lo; there ok more seen")]


def split(spark, texts, abbreviations):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["s"] for r in df.orderBy("i").select(X.sentences("t", abbreviations).alias("s")).collect()]


def test_hand_marked_sentences(spark):
    corpus = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    known = X.learn_abbreviations(corpus, "text")
    assert {"dr", "mr", "fig", "cf", "approx", "env", "prof", "ca", "vgl", "abb", "pág", "z.b", "e.g", "sp"} <= set(known)
    assert not {"trees", "bäume", "arbres", "árboles", "informe", "rose", "so", "died"} & set(known)
    want = [[s.strip() for s in t.split("|")] for t in MARKED]
    got = split(spark, [t.replace("|", "") for t in MARKED], known)
    right = sum(len(set(a) & set(b)) for a, b in zip(got, want))
    total = sum(map(len, want))
    rules = split(spark, [t.replace("|", "") for t in MARKED], None)
    by_rules = sum(len(set(a) & set(b)) for a, b in zip(rules, want))
    # "12 sp. Nothing" is a true end behind an abbreviation: not to be told apart
    assert right >= total - 2 and by_rules < total / 2
    assert split(spark, ["", "one", "A.\nB. C", None], known) == [[], ["one"], ["A.", "B. C"], None]


def test_keyword_sentences_stay_whole(spark):
    df = spark.createDataFrame([("Xylella fastidiosa subsp. pauca was seen at 3.5 m. Nothing else was.",)], "t string")
    kept = df.select(X.relevant_sentences("t", ["subsp"]).alias("s")).first()["s"]
    assert kept == "Xylella fastidiosa subsp. pauca was seen at 3.5 m."
    assert X.learn_abbreviations(df.where("false"), "t") == []


def test_written_splits_quote_text_and_not_numbers(spark):
    rows = [(1, "plain words", 1, 0.5, True, "train"), (2, 'a "b", c\nd', 0, None, False, "train"), (3, None, 1, 2.0, None, "dev")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels int, score double, flag boolean, split string")
    path = IO.write_splits(df, IO.scratch_path(spark, "s8"), by=("split",))
    files = glob.glob(f"{path.replace('file:', '')}/split=train/part=*/*.txt")
    texts = [open(f, newline="").read() for f in files]
    header = '"doc_id","text","labels","score","flag"\n'
    assert all(t.startswith(header) and t.count(header) == 1 for t in texts)
    assert {t[len(header):] for t in texts} in ({'1,"plain words",1,0.5,"true"\n', '2,"a ""b"", c\nd",0,,"false"\n'},
                                                {'1,"plain words",1,0.5,"true"\n2,"a ""b"", c\nd",0,,"false"\n'})
    back = IO.read_splits(spark, path, "doc_id long, text string, labels int, score double, flag boolean")
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert spark.read.text(path).where(F.col("value") == "").count() == 0


def test_words_are_counted_as_they_stand_before_marks_are_taken_off(spark):
    texts = ["Dr. (Dr.) dr., «cf. x» cf. cf\tA. B a.. ... . , «» 3.5. 3.5", "", None, "  \n ", "e.g. e.g E.G.", "Dr. Dr. sp.' sp"]
    df = spark.createDataFrame([(t,) for t in texts * 3], "text string")
    n = {}
    for t in texts * 3:
        for w in [x for x in re.split(f"[{''.join(P.WS_CHARS)}]+", (t or "").lower()) if x]:
            w = re.sub(r"""^[^\w]+|[,;:!?)\]»”’"']+$""", "", w)
            stop = bool(re.search(r"[^.]\.$", w))
            word = w[:-1] if stop else w
            n[word] = [a + b for a, b in zip(n.get(word, [0, 0]), [1, int(stop)])]
    got = X.abbreviation_scores(df, "text")
    want = {w: tuple(v) for w, v in n.items() if v[1] >= 2 and re.fullmatch(r"[^\W\d_.][^\W\d_.]*(?:\.[^\W\d_]+)*", w)}
    assert {r["word"]: (r["n"], r["k"]) for r in got.collect()} == want and want["dr"] == (15, 15)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "word-counts" in " ".join(got.inputFiles())  # the texts are split once, not for the totals again


def test_sentence_break_tells_cheap_things_first_and_breaks_as_before(spark):
    words = ["dr", "d", "e.g", "fig", "figs", "f", "pág", "st"]
    known = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    after = rf"(?<![^\p{{L}}\p{{Nd}}.](?iu:{known})\.)(?<!^(?iu:{known})\.)"
    old = (rf"(?<=[.!?…][\"'\p{{Pf}}\p{{Pe}}]{{0,2}}){after}(?<![^\p{{L}}\p{{Nd}}]\p{{Lu}}\.)(?<!^\p{{Lu}}\.)"
           rf"[{P.WS}]+(?={X.OPENING})")
    rng = random.Random(5)
    parts = ["Dr.", "dr.", "D.", "x", "Fig.", "figs.", "FIGS.", "(st.", "e.g.", "E.G.", " ", "  ", " ", "A", "b.", "Q.", "!", "?\"", ".)", "…", "3", "¿", "oak"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    assert df.where(~F.split("t", X.sentence_break(words)).eqNullSafe(F.split("t", old))).count() == 0
    assert X.sentence_break(words).startswith(f"(?=[{P.WS}])") and X._tree(["ab", "abc"]) == "ab(?:c|)"


def test_keywords_are_looked_for_before_sentences_are_made(spark):
    texts = ["An OAK. No.", "Wılt here. x", "ſpodoptera. y", "Popİllia japonica? z", "toKen oaK. b", "none. here", "oa k", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    old = F.coalesce(F.col("t").rlike(P.java(X.keyword_pattern(), ignore_case=True)), F.lit(False))
    got = df.select("i", X.contains_keywords("t").alias("new"), old.alias("old"), X.relevant_sentences("t").alias("s")).orderBy("i").collect()
    assert [r.new for r in got] == [r.old for r in got] == [r.s is not None for r in got] and sum(r.new for r in got) == 5
    assert "contains(" in df.select(X.relevant_sentences("t"))._jdf.queryExecution().toString().lower()
