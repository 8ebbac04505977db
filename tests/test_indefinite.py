"""Nouns and the articles they get, by language."""

from pyspark.sql import functions as F

from glossa.functions.indefinite import with_indefinite

STORY = "Há uma semana que sinto dormência na face esquerda. A sensação estende-se da orelha ao olho e ao nariz. Também tenho tido problemas de visão e tonturas ligeiras. Não há história conhecida de distúrbios na minha família próxima."
#: lang, noun, forms, text, result
CASES = [
    ("pt", "um cão", [], "", "um cão"), ("pt", "o cão", [], "", "um cão"), ("pt", "a face", [], "", "uma face"), ("pt", "os cães", [], "", "um cães"), ("pt", "as faces", [], "", "uma faces"),
    ("pt", "face", ["face"], STORY, "uma face"), ("pt", "olho", ["olho"], STORY, "um olho"), ("pt", "orelha", ["orelha"], STORY, "uma orelha"), ("pt", "sensação", ["sensação"], STORY, "uma sensação"), ("pt", "nariz", ["nariz"], STORY, "um nariz"), ("pt", "problema", ["problemas"], STORY, "um problema"), ("pt", "visão", ["visão"], STORY, "uma visão"), ("pt", "tontura", ["tonturas"], STORY, "uma tontura"), ("pt", "família", ["família"], STORY, "uma família"), ("pt", "distúrbio", ["distúrbios"], STORY, "um distúrbio"),
    ("pt", "liberdade", [], "", "uma liberdade"), ("pt", "sistema", [], "", "um sistema"), ("pt", "casa", [], "", "uma casa"), ("pt", "livro", [], "", "um livro"), ("pt", "asa", [], "", "uma asa"), ("pt", "problema", ["problemas"], "os problemas persistentes", "um problema"), ("pt", "o médico, a médica", [], "", "um médico, uma médica"), ("pt", "cidade", ["cidade"], "pela cidade", "uma cidade"), ("pt", "trabalho", ["trabalho"], "pelo trabalho", "um trabalho"), ("pt", "face", ["face"], "uma faceta interessante", "um face"),
    ("es", "un perro", [], "", "un perro"), ("es", "el perro", [], "", "un perro"), ("es", "la casa", [], "", "una casa"), ("es", "libertad", [], "", "una libertad"), ("es", "nación", [], "", "una nación"), ("es", "problema", [], "", "un problema"), ("es", "día", [], "", "un día"), ("es", "niño", ["niño"], "del niño", "un niño"),
    ("it", "il cane", [], "", "un cane"), ("it", "la casa", [], "", "una casa"), ("it", "studio", [], "", "uno studio"), ("it", "zio", [], "", "uno zio"), ("it", "amico", [], "", "un amico"), ("it", "amica", [], "", "un'amica"), ("it", "l'amica", [], "", "l'amica"), ("it", "un'amica", [], "", "un'amica"),
    ("fr", "le chien", [], "", "un chien"), ("fr", "la maison", [], "", "une maison"), ("fr", "livre", [], "", "livre"), ("fr", "nation", [], "", "une nation"), ("fr", "liberté", [], "", "une liberté"), ("fr", "fromage", [], "", "un fromage"), ("fr", "tableau", [], "", "un tableau"), ("fr", "pain", ["pain"], "du pain", "un pain"), ("fr", "les gens", [], "", "les gens"), ("fr", "pain", [], "les pain", "pain"),
    ("de", "ein Hund", [], "", "ein Hund"), ("de", "der Hund", [], "", "ein Hund"), ("de", "die Katze", [], "", "eine Katze"), ("de", "das Kind", [], "", "ein Kind"), ("de", "Hund", [], "", "Hund"), ("de", "Hund", ["Hund"], "Der Hund bellt.", "ein Hund"), ("de", "Katze", ["Katze"], "Die Katze schläft.", "eine Katze"), ("de", "Hund", ["Hund"], "Er sieht den Hund.", "ein Hund"), ("de", "der Arzt, die Ärztin", [], "", "ein Arzt, eine Ärztin"),
    ("de", "Band", [], "die Band und das Band", "eine Band"), ("de", "Band", [], "das Band, das Band, der Band, der Band, der Band, das Band, das Band", "ein Band"), ("de", "See+", [], "die See+ hier", "eine See+"),
    ("nl", "hond", [], "", "een hond"), ("nl", "de hond", [], "", "een hond"), ("nl", "een huis", [], "", "een huis"),
    ("en", "a dog", [], "", "a dog"), ("en", "the apple", [], "", "an apple"), ("en", "ancestor", [], "", "an ancestor"), ("en", "hour", [], "", "an hour"), ("en", "house", [], "", "a house"), ("en", "university", [], "", "a university"), ("en", "uniform", [], "", "a uniform"),
    ("sv", "ett språk", [], "", "ett språk"), ("sv", "hund", [], "", "en hund"), ("sv", "barn", ["barn"], "ett barn", "ett barn"), ("no", "ei bok", [], "", "ei bok"), ("no", "bok", ["bok"], "ei bok", "en bok"), ("da", "barn", ["barn"], "et barn", "ett barn"),
    ("pl", "pies", [], "", "pies"), ("cs", "pes", [], "", "pes"), ("xx", "anything", [], "", "anything"), ("pt", "", [], "", ""), ("pt", "   ", [], "", "   "), ("pt", None, [], "", None), ("pt", "casa", None, None, "uma casa"), (None, "casa", [], "", "casa"),
]


def test_articles(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, lang string, noun string, forms array<string>, text string, want string")
    got = {r.i: r.got for r in df.select("i", with_indefinite(F.col("noun"), F.col("forms"), F.col("text"), F.col("lang")).alias("got")).collect()}
    assert {i: (c[0], c[1], got[i]) for i, c in enumerate(CASES) if got[i] != c[-1]} == {}
