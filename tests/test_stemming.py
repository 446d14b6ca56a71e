"""Stems against samples that were published with the rules, and in the index."""

from pyspark.sql import functions as F

from postrider.functions.stemming import stem, stems
from postrider.operators.postings import TextIndex
from postrider.operators.ranking import Terms

SAMPLES = """consign consign|consigned consign|consigning consign|consignment consign|consist consist|consisted consist|consistency consist|consistent consist|consistently consist|consisting consist|consists consist
consolation consol|consolations consol|consolatory consolatori|console consol|consoled consol|consoles consol|consolidate consolid|consolidated consolid|consolidating consolid|consoling consol|consolingly consol|consols consol
consonant conson|consort consort|consorted consort|consorting consort|conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci|conspirator conspir|conspirators conspir|conspire conspir|conspired conspir|conspiring conspir
constable constabl|constables constabl|constance constanc|constancy constanc|constant constant|knack knack|knackeries knackeri|knacks knack|knag knag|knave knave|knaves knave|knavish knavish|kneaded knead|kneading knead|knee knee
kneel kneel|kneeled kneel|kneeling kneel|kneels kneel|knees knee|knell knell|knelt knelt|knew knew|knick knick|knif knif|knife knife|knight knight|knightly knight|knights knight|knit knit|knits knit|knitted knit|knitting knit
knives knive|knob knob|knobs knob|knock knock|knocked knock|knocker knocker|knockers knocker|knocking knock|knocks knock|knopp knopp|knot knot|knots knot"""
RULES = """caresses caress|ties tie|cries cri|gas gas|this this|gaps gap|kiwis kiwi|luxuriated luxuri|hopping hop|hoped hope|hoping hope|bead bead|shed shed|bed bed|say say|by by|cry cri|enjoy enjoy|skies sky|dying die|news news
proceeding proceed|succeeds succeed|herrings herring|generate generat|generous generous|communism communism|agreed agre|feed feed|nationality nation|rational ration|usefulness use|goodness good|formative format|adoption adopt|analogies analog
cheerfully cheer|hopelessly hopeless|rate rate|controlling control|roll roll|dog's dog|dogs' dog|boyish boyish|youth youth|is is|naïvely naïv|running run|happiness happi|relational relat"""


def test_published_samples():
    for line in (SAMPLES + "|" + RULES).replace("\n", "|").split("|"):
        word, want = line.split()
        assert stem(word) == want, word


def test_distinct_words(spark):
    words = spark.createDataFrame([("running",), ("running",), ("Y",), (None,), ("",)], "word string")
    assert sorted(map(tuple, stems(words).collect())) == [("", ""), ("Y", "Y"), ("running", "run")]


def test_search_finds_inflected_forms(spark, tmp_path):
    m = spark.createDataFrame([(1, "Meetings were planned"), (2, "a meeting, planning"), (3, "meat"), (4, "The meet of planners")], "id long, body string")
    index = TextIndex(spark, str(tmp_path / "i"), stemmed=True)
    index.build(m, F.lit(""), F.col("body"))
    found = lambda *groups, without=(): sorted(x.id for x in index.ranks(Terms(groups, without)).collect())
    assert found(("meet",)) == [1, 2, 4] and found(("meets",), ("plans",)) == [1, 2] and found(("meetings were",)) == [1]
    assert found(("meet",), without=("planners",)) == [1, 2]
