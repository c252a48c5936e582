import re
import string

import pytest
from pyspark.sql import functions as F

from skillscope.functions.stem import stem_token
from skillscope.functions.text import clean_message, clean_tokens, keyword_tokens, normalized_text, tidy_split
from skillscope.operators.tagging import prepare_taxonomy, tag_documents, tag_mentions


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_html_clean(spark):
    html = ('<html><head><style>p{x}</style><script>var t="</p>";</script></head><body><!-- ad -->'
            '<p>Hello&nbsp;<b>big</b>\n\tworld &amp;lt; see https://x.example.org/a?b=1 now</p></body></html>')
    out = one(spark, normalized_text, html)
    assert "var t" not in out and "p{x}" not in out and "ad" not in out.split()
    assert "https" not in out
    assert " ".join(out.split()) == "Hello big world &lt; see now"


def test_tokens_punct_letters_lowercase(spark):
    assert one(spark, clean_tokens, "Hello, World! 42 3.14 e.g. don't ... Ünïcode ñ") == [
        "hello", "world", "eg", "do", "nt", "ünïcode"]
    assert one(spark, clean_tokens, 'python(pandas) machine-learning,deep "learning" 3,141 it\'s a--b x:y') == [
        "python", "pandas", "machinelearning", "deep", "learning", "it", "s", "a", "b", "x", "y"]


def test_tags_and_entities(spark):
    assert one(spark, normalized_text, "a < b and c > d <b>regression</b>") == "a < b and c > d regression "
    cases = {"it&#8217;s": "it\u2019s", "&eacute;tude &#xE9; &#XE9;": "\u00e9tude \u00e9 \u00e9", "&amp;lt;": "&lt;",
             "AT&T &unknown; &#0; &#55296; &": "AT&T &unknown; \ufffd \ufffd &", "&apos;&hellip;&#128512;": "'\u2026\U0001f600"}
    for raw, want in cases.items():
        assert one(spark, normalized_text, raw) == want


def test_stem_examples(spark):
    words = {"learning": "learn", "learned": "learn", "classes": "class", "cats": "cat", "is": "is",
             "national": "nation", "happiness": "happi", "quickly": "quick", "bus": "bus", "ponies": "poni"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem_token(F.col("w")).alias("s"))
    assert {r["w"]: r["s"] for r in df.collect()} == words


def test_empty_message(spark):
    assert one(spark, clean_message, "  ") == ""


def test_two_word_tag_matches_text(spark):
    # Q6: the tag and the text go through the same token rules
    kw = one(spark, lambda c: F.array_join(keyword_tokens(c), " "), "Machine Learning")
    msg = one(spark, clean_message, "We like <b>machine</b> learning.")
    assert kw in msg


def test_leftmost_longest_overlap(spark):
    tax = prepare_taxonomy(spark.createDataFrame(
        [("a", "A"), ("a b", "AB"), ("b c d", "BCD"), ("d", "D")], "keyword string, Name string"))
    docs = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["x"]), (3, ["d", "a", "d"])],
                                 "id int, tokens array<string>")
    out = {r["id"]: r["names"] for r in tag_documents(docs, "tokens", ["id"], tax).collect()}
    assert out == {1: ["AB", "D"], 3: ["D", "A", "D"]}
    m = tag_mentions(docs, "tokens", ["id"], tax).collect()
    assert sorted((r["id"], r["pos"], r["Name"]) for r in m) == [
        (1, 0, "AB"), (1, 1, "D"), (3, 0, "D"), (3, 1, "A"), (3, 2, "D")]


def test_same_keyword_smallest_name_wins(spark):
    tax = prepare_taxonomy(spark.createDataFrame([("k", "zeta"), ("k", "alpha")], "keyword string, Name string"))
    assert [r["Name"] for r in tax.collect()] == ["alpha"]


def test_tidy_split(spark):
    df = spark.createDataFrame([("['a', 'b c']",), ("x",)], "s string")
    got = [r["v"] for r in df.select(F.explode(tidy_split("s")).alias("v")).collect()]
    assert got == ["a", "b c", "x"]
    kept = [r["v"] for r in df.select(F.explode(tidy_split("s", keep=True)).alias("v")).collect()]
    assert kept == ["a, b c", "a", "b c", "x"]


def test_phrases_of_three_and_more_tokens(spark):
    tax = prepare_taxonomy(spark.createDataFrame(
        [("a b c d", "LONG"), ("b c", "BC"), ("c d e", "CDE"), ("e", "E")], "keyword string, Name string"))
    docs = spark.createDataFrame([(1, list("abcde")), (2, list("xbcde")), (3, list("cdabcd")), (4, [])],
                                 "id int, tokens array<string>")
    out = {r["id"]: r["names"] for r in tag_documents(docs, "tokens", ["id"], tax).collect()}
    assert out == {1: ["LONG", "E"], 2: ["BC", "E"], 3: ["LONG"]}
    none = tag_mentions(docs, "tokens", ["id"], tax.limit(0))
    assert none.columns == ["id", "pos", "Name"] and none.count() == 0


def test_one_hot(spark):
    from skillscope.plans.model import one_hot
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, cat string")
    out = one_hot(df, "cat")
    assert out.columns == ["id", "cat_a", "cat_b"]
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, 0, 0)]


PUBLISHED = """consign consigned:consign consigning:consign consignment:consign consistency:consist consistently:consist
consolation:consol consolatory:consolatori console:consol consolidate:consolid consolidating:consolid consolingly:consol
consonant:conson conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci conspirators:conspir conspiring:conspir
constable:constabl constancy:constanc constant knackeries:knackeri knaves:knave knavish kneeled:kneel knees:knee knightly:knight
knitted:knit knitting:knit knives:knive knocker knockers:knocker skis:ski dying:die news early:earli inning succeed
generously:generous generate:generat communism:communism hopping:hop hoping:hope cries:cri cried:cri ties:tie tie gas gaps:gap
kiwis:kiwi by say cry:cri happy:happi agreed:agre luxuriated:luxuri relational:relat rationalization:ration
adjustment:adjust roll yes:yes youth boy:boy sayings:say"""


def test_published_pairs_of_the_english_stemmer(spark):
    pairs = dict((p.split(":") * 2)[:2] for p in PUBLISHED.split())
    got = spark.createDataFrame([(w,) for w in pairs], "w string").select("w", stem_token(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in got} == pairs


def test_vocabulary_stems_equal_stems_in_place(spark):
    from skillscope.functions.stem import stem_tokens, stemmed_rows, stemmed_vocabulary
    rows = [(1, ["running", "dogs", "running"]), (2, []), (3, None), (4, ["nationally", "x", "relational"])]
    docs = spark.createDataFrame(rows, "id int, tokens array<string>")
    vocab = stemmed_vocabulary(docs)
    assert {(r.token, r.doc_count) for r in vocab.collect()} == {
        ("running", 1), ("dogs", 1), ("nationally", 1), ("x", 1), ("relational", 1)}
    want = {r["id"]: r["s"] for r in docs.select("id", stem_tokens(F.col("tokens")).alias("s")).collect()}
    assert {r["id"]: r["tokens"] for r in stemmed_rows(docs, "id", "tokens", vocab).collect()} == want
    assert want == {1: ["run", "dog", "run"], 2: [], 3: None, 4: ["nation", "x", "relat"]}


def test_sentences_with_learned_abbreviations(spark):
    from skillscope.functions.sentences import abbreviations, sentences, text_words
    texts = {1: "We met Dr. Smith at approx. 5 p.m. Then he left! Why? \"No idea.\" (It rained.) v1.2 is out.",
             2: "Ask Dr. Jones. Dr. Who came at approx. noon, or approx. 1 p.m. on Monday, 3 p.m. Tuesday.",
             3: "", 4: None, 5: "no mark at all", 6: "The idea. The idea. the idea, an idea; Idea<br/>One <b>idea</b>"}
    docs = spark.createDataFrame(list(texts.items()), "id int, t string").select("id", text_words("t").alias("words"))
    short = abbreviations(docs)
    assert {(r.word, r.n_dotted, r.n_plain) for r in short.collect()} == {("dr", 3, 0), ("approx", 3, 0), ("p.m", 3, 0)}
    words = {r["id"]: r["words"] for r in docs.collect()}
    got = {}
    for r in sentences(docs, "id", short).orderBy("id", "sentence").collect():
        got.setdefault(r["id"], []).append(" ".join(words[r["id"]][r.first_word:r.first_word + r.n_words]))
    assert got == {
        1: ["We met Dr. Smith at approx. 5 p.m. Then he left!", "Why?", '"No idea."', "(It rained.) v1.2 is out."],
        2: ["Ask Dr. Jones.", "Dr. Who came at approx. noon, or approx. 1 p.m. on Monday, 3 p.m. Tuesday."],
        5: ["no mark at all"], 6: ["The idea.", "The idea. the idea, an idea; Idea One idea"]}


def test_tokens_equal_plain_rules_on_odd_spacing(spark):
    """Tokens without a letter at the ends, in a row
    and before a letter, runs of mixed white space, and endings of contractions in both cases."""
    texts = ["12 34 a 5 6", "1", "", " ", "a", "\n 7\t8  b9  　 9b\r\n", "x  \n\n   y", "1234a 12.5 3,4 a1 да été z",
             "Don'T we'LL 'tis it's, 5's n't", "a 2 b", "  lead 1 2 3", "trail 1 2 3  "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    got = {r["id"]: r["t"] for r in df.select("id", clean_tokens("s").alias("t")).collect()}

    def plain(s):
        s = re.sub("[\t\n\x0b\f\r   -  　]+", " ", s)
        s = re.sub(r"[\[\](){}<>;@#$%&?!\"]|--+|\.\.\.+", " ", s)
        s = re.sub("[:,]([^0-9]|$)", r" \1", s)
        s = re.sub("(?i)('ll|'re|'ve|n't|'s|'m|'d)([^a-zA-Z]|$)", r" \1\2", s)
        words = ["".join(c for c in w if c not in string.punctuation) for w in s.split(" ")]
        return [w.lower() for w in words if re.search("[a-zA-Z]", w)]
    assert got == {i: plain(s) for i, s in enumerate(texts)}
