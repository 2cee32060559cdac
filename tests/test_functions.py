import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.cardinals import cardinal
from gleaner.functions.html import article_text, article_text_sql, extract_article
from gleaner.functions.porter import stem


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("word, expected", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"),
    ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"),
    ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("valenci", "valenc"), ("digitizer", "digit"), ("operator", "oper"),
    ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("formaliti", "formal"), ("sensitiviti", "sensit"), ("sensibiliti", "sensibl"),
    ("triplicate", "triplic"), ("formative", "form"), ("formalize", "formal"), ("electrical", "electr"), ("hopeful", "hope"), ("goodness", "good"),
    ("revival", "reviv"), ("allowance", "allow"), ("inference", "infer"), ("airliner", "airlin"), ("adjustable", "adjust"), ("replacement", "replac"),
    ("adjustment", "adjust"), ("dependent", "depend"), ("adoption", "adopt"), ("homologou", "homolog"), ("effective", "effect"), ("bowdlerize", "bowdler"),
    ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("at", "at"),
])
def test_stems(word, expected):
    assert stem(word, extended=False) == expected


@pytest.mark.parametrize("word, expected", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("dies", "die"), ("flies", "fli"), ("tied", "tie"), ("died", "die"), ("cried", "cri"),
    ("dying", "die"), ("lying", "lie"), ("tying", "tie"), ("news", "news"), ("innings", "inning"), ("outing", "outing"), ("cannings", "canning"), ("howe", "howe"),
    ("proceed", "proceed"), ("exceed", "exceed"), ("succeed", "succeed"), ("agreed", "agre"), ("sky", "sky"), ("skies", "sky"), ("happy", "happi"), ("enjoy", "enjoy"),
    ("by", "by"), ("spy", "spi"), ("say", "say"), ("aged", "age"), ("using", "use"), ("used", "use"), ("hopping", "hop"), ("falling", "fall"), ("fizzed", "fizz"),
    ("sensibly", "sensibl"), ("hopefully", "hope"), ("rationally", "ration"), ("geology", "geolog"), ("geological", "geolog"), ("relational", "relat"), ("controlling", "control"),
])
def test_extended_stems(word, expected):
    assert stem(word) == expected


@pytest.mark.parametrize("n, expected", [
    (0, "zero"), (7, "seven"), (19, "nineteen"), (25, "twenty-five"), (40, "forty"), (100, "one hundred"), (342, "three hundred and forty-two"),
    (1000, "one thousand"), (1005, "one thousand and five"), (1234, "one thousand, two hundred and thirty-four"), (1_000_000, "one million"),
    (2_000_100, "two million, one hundred"), (10**33, "one decillion"), (10**303, "one centillion"),
])
def test_cardinals(n, expected):
    assert cardinal(n) == expected


def test_long_numbers_are_spelled_in_blocks():
    assert T.number_words(["1" * 306]) == [cardinal(int("1" * 306))]
    assert T.number_words(["1" * 307]) == [cardinal(int("1" * 306)) + " one"]
    assert T.number_words(["᧑", "x"]) == ["x"]  # New Tai Lue digits go
    assert T.number_words(["፩"]) == ["፩"]  # a digit without an integer value


def test_punctuation_and_raised_digits(spark):
    assert one(spark, "don't, stop", T.remove_punctuation) == "dont stop"
    assert one(spark, "a-b", T.remove_punctuation) == "a b"
    assert one(spark, "x² + y¹⁰ z", T.replace_superscripts) == "x^2  + y^10  z"
    assert one(spark, "H₂", T.replace_subscripts) == "H^2 "
    assert one(spark, "① ⑳ ㉑ ㊿ ⓪ ⓿ ⓴ ⒇ ➓ ❿ ⓾", T.special_numbers) == "(1) (20) (21) (50) (0) (0) (20) (20) (10) (10) (10)"
    assert one(spark, None, T.remove_punctuation) is None


def test_simple_words(spark):
    assert one(spark, "The  Cat's\tand a dog-house, 7!", T.simple_words) == ["cats", "dog", "house"]
    assert one(spark, None, T.simple_words) == []
    assert one(spark, "", T.simple_words) == []


def test_stems_in_sql_are_the_same():
    import duckdb

    from gleaner.plans.stem_sql import stems

    parts = ["", "re", "con", "syll", "y", "happ", "hop", "fall", "fizz", "agre", "geo", "rat", "x", "bl", "ti", "sky"]
    endings = "s es ies ied ed eed ing ational tional enci izer bli alli fulli entli eli ousli ization ator alism iveness ousness aliti biliti logi icate ative alize iciti ical ful ness ement ance ion tion sion e ll y ate iti".split()
    words = sorted({a + b + c for a in parts for b in parts for c in endings if "yy" not in a + b + c} | {"dying", "news", "proceed", "skies"})
    got = duckdb.connect().execute("WITH w AS (SELECT unnest($1) AS word), " + stems("z", "w") + " SELECT word, stem FROM z", [words]).fetchall()
    assert dict(got) == {w: stem(w) for w in words}


@pytest.mark.parametrize("text, expected", [
    ("i cannot go", ["i", "can", "not", "go"]), ("gonna wannabe", ["gon", "na", "wannabe"]), ("“smart” «quotes» and ‘these’", ["smart", "quotes", "and", "these"]),
    ("xcannot cannotx lemme", ["xcannot", "cannotx", "lem", "me"]), ("gimme\tgotta", ["gim", "me", "got", "ta"]), (None, []), ("", []),
])
def test_words(spark, text, expected):
    assert one(spark, text, T.tokens) == expected
    assert T.word_list(text or "") == expected


def test_lemmas(spark):
    rows = spark.createDataFrame([("geese", "goose"), ("mice", "mouse"), ("mice", "mice"), (None, "x"), ("y", None)], "word string, lemma string")
    lemmas = T.load_lemmas(rows)
    assert lemmas == {"geese": "goose", "mice": "mice"} and T.full_words_of("geese", lemmas) == ["goo"]
    with pytest.raises(ValueError):
        T.load_lemmas(rows, most=1)


def test_full_profile(spark):
    assert T.full_words_of("x² squared") == ["two", "squar"]
    assert T.full_words_of("He walked 25 miles, don't stop") == ["walk", "twenti", "mile", "dont", "stop"]  # a hyphenated cardinal is stemmed as one word first: twenty-f
    assert T.full_words_of("geese", {"geese": "goose"}) == ["goo"]  # stemmed twice
    assert T.full_words_of(None) == [] and T.full_words_of("") == []
    assert one(spark, "Running ①5", T.full_words()) == T.full_words_of("Running ①5")


def test_small_text_functions(spark):
    assert one(spark, "a\n\n\n\nb\n\n\n", lambda c: T.paragraphs(c)) == ["a", "b"]
    assert one(spark, "hello", lambda c: T.passage(c, F.lit(1), F.lit(3))) == "el"
    assert one(spark, "dir/inverted_index_12.msgpack", T.shard_number) == 12
    assert one(spark, "other", T.shard_number) == -1
    assert one(spark, "<redirect/><sha1> ab </sha1>", T.redirect_hash) == "ab"
    assert one(spark, "<sha1>ab</sha1>", T.redirect_hash) is None
    assert one(spark, "<redirect/>", T.redirect_hash) is None
    assert tuple(one(spark, "data/wiki.xml_abc", T.file_and_hash)) == ("wiki.xml", "abc")
    assert one(spark, "abc", T.content_hash) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_articles():
    page = '<html><script>x</script><article id=1><p>A &amp; <b>B</b><!-- no --><script>var t="</p>"</script><article>in</article>.</article><article>second</article>'
    assert extract_article(page) == "A & Bin."
    assert extract_article('<header id="mntl-external-basic-sublayout_1-0">H</header>') == "H"
    assert extract_article("<p>none</p>") is None
    assert extract_article(None) == ""


def test_parser_and_built_in_extraction_agree(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.select(article_text("html").alias("a"), article_text_sql(F.col("html")).alias("b")).collect()
    assert rows and all(r.a == r.b for r in rows)
