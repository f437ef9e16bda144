"""Secret scans in DataFrame functions alone: patterns find candidates, a random forest removes false positives."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize

#: Names that go before a secret, as in `token = "..."`.
NAMES = r"(?:passwords?|passwd|pwd|secrets?|tokens?|api[_-]?keys?|access[_-]?keys?|auth[_-]?keys?|private[_-]?keys?|credentials?)"
#: A name and what stands between it and its value; quotes may be escaped, as in JSON inside of JSON.
_NAMED = rf"(?i:\b[a-z0-9_-]{{0,32}}{NAMES}(?:\\?[\"'])?\s{{0,2}}[:=]\s{{0,2}})"
#: The scheme and the user of a URL that goes on with a password.
_URL = r"\b[a-zA-Z][a-zA-Z0-9+.-]{1,30}://[^\s:/@\"']*+:"
ASSIGNED = rf"(?:{_NAMED}(?:\\?[\"'])?|{_URL})"
#: The public forms of known tokens.
PREFIXED = r"\b(?:sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|npm_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16,}|AIza[A-Za-z0-9_-]{35,}|eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
#: A key block to its END line, or to the text's end without one.
PEM = r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?s:.*?)(?:-----END [A-Z ]{0,32}PRIVATE KEY-----|\z)"
#: A whole token with a digit; what stands before an equals sign is a name and no part of it.
RANDOM = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/=-]{20,}"
#: A value in quotes goes to the closing one, one without to white space, a URL's password to the sign before the host.
CANDIDATE = rf"{_URL}[^\s@/\"']++(?=@)|{_NAMED}(?:(?:\\?[\"'])?{PEM}|\"[^\"\\\n]{{8,}}(?=\")|'[^'\\\n]{{8,}}(?=')|\\\"[^\"\\\n]{{8,}}(?=\\\")|(?:\\?[\"'])?\S{{8,}})|{PREFIXED}|{PEM}|{RANDOM}"
#: Characters of text on either side in which neighbouring words are looked for.
NEAR = 64
#: Words of placeholders and identifiers, in the dictionary whatever the documents hold; the rest of it is what they hold most.
WORDS = (
    "about account after all and any are article back batch because been before build but can change client code commit config content count could data date day default demo "
    "document does draft dummy end event example fake file final first for foo bar from get good has have here home image into item its just key know last like line list local "
    "main make man many master message more most name new not now number one only other our out over page part people place placeholder please product project public query "
    "release report request return row sample say section see server service session set should site some source stage start state string such table take test text than that "
    "the their them then there these they thing this time token two type use user value version very was way web week well what when which who will with word work world would "
    "year you your change change_me changeme insert replace redacted secret password lorem ipsum abcdef abcd qwerty letmein xxxx 1234 0000"
).split()
SECRET_NEAR = rf"(?i)(?:{NAMES}|bearer|authorization|login|aws|oauth)"
HARMLESS_NEAR = r"(?i)(?:\bsha\d*|\bmd5\b|checksum|digest|commit|revision|\brev\b|uuid|guid|\betag\b|hash|integrity|build|version|order|invoice|tracking|isbn|serial|example|sample|placeholder|dummy|fake|docs?\b|image|href|src|base64,)"
HARMLESS_PATH = r"(?i)(?:test|spec|fixture|example|sample|docs?|vendor|node_modules|lock|min\.js)"
#: Words that the dictionary takes from the documents, their least length, and how often one occurs at least: a password does not.
COMMON, LEAST, OFTEN = 2000, 4, 20
FEATURES = ["n", "transitions", "digits", "uppers", "distinct", "hexadecimal", "covered", "longest_word", "assigned", "prefixed", "secret_near", "harmless_near", "harmless_path", "symbols"]
#: Trees of the forest, their depth, generated labelled findings, and the share of votes from which a finding stays.
TREES, DEPTH, FINDINGS, VOTES = 24, 8, 8000, 0.5


def _path(docs: DataFrame, path: str | None) -> Column:
    return F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")


def _hits() -> Column:
    return F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))


def _gaps() -> Column:
    """The pieces of the text before, between and after the hits."""
    return F.split("text", CANDIDATE, -1)


def _value(found: Column) -> Column:
    return F.regexp_replace(found, F.concat(F.lit("^"), F.lit(ASSIGNED)), F.lit(""))


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """(doc_id, path, text_hash, nth, start, found, value, before, after): what looks like a secret in every whole text.

    The pieces between the matches, which split() gives, stand in line with
    the matches themselves; so each one's neighbours come without a search,
    and its place by a running sum over the text's matches.  A null text has
    none.  start counts characters from 0, nth the matches.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _path(docs, path).alias("path"))
    hit = docs.where(F.col("text").rlike(CANDIDATE)).withColumns({"hits": _hits(), "gaps": _gaps(), "text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    pieces = F.arrays_zip(
        F.col("hits").alias("found"),
        F.transform(F.slice("gaps", F.lit(1), F.size("hits")), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(NEAR)).alias("text"))).alias("before"),
        F.transform(F.slice("gaps", F.lit(2), F.size("hits")), lambda g: F.left(g, F.lit(NEAR))).alias("after"),
    )
    out = hit.select("doc_id", "path", "text_hash", "row", F.posexplode(pieces).alias("nth", "x"))
    upto = Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("x.before.n") + F.length("x.found")).over(upto) - F.length("x.found")
    return out.select("doc_id", "path", "text_hash", "nth", start.cast("long").alias("start"), F.col("x.found").alias("found"), _value(F.col("x.found")).alias("value"), F.col("x.before.text").alias("before"), F.col("x.after").alias("after"))


def common_words(docs: DataFrame, n: int = COMMON) -> tuple[str, ...]:
    """The n words of the documents that occur most, of letters a to z alone, counted over all whole texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("word")).where(F.length("word").between(LEAST, 24))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return tuple(r.word for r in counts.orderBy(F.desc("n"), "word").limit(n).collect())


def with_features(found: DataFrame, words: tuple[str, ...] = ()) -> DataFrame:
    """What the forest is asked: length, character transitions, dictionary coverage, path and neighbouring words.

    words: what the dictionary holds besides WORDS.
    """
    v, low = F.col("value"), F.lower("value")
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    dictionary = "|".join(sorted({w for w in (*WORDS, *words) if len(w) > 2}, key=lambda w: (-len(w), w)))
    rest = F.length(F.regexp_replace(low, F.lit(dictionary), F.lit("")))
    number = lambda c: c.cast("double")
    features = {
        "n": n,
        "transitions": F.regexp_count(v, F.lit(change)) / n,
        "digits": F.regexp_count(v, F.lit("[0-9]")) / n,
        "uppers": F.regexp_count(v, F.lit("[A-Z]")) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64.0)),
        "hexadecimal": number(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "covered": 1 - rest / n,
        "longest_word": F.length(F.regexp_extract(low, "([a-z]{4,})", 1)) / n,
        "assigned": number(F.col("found").rlike("^" + ASSIGNED)),
        "prefixed": number(v.rlike(f"^(?:{PREFIXED}|{PEM})")),
        "secret_near": number(F.col("before").rlike(SECRET_NEAR)),
        "harmless_near": number(F.concat("before", F.lit(" "), "after").rlike(HARMLESS_NEAR)),
        "symbols": F.regexp_count(v, F.lit(r"[^A-Za-z0-9_.()\[\]{}<>/-]")) / n,
        "harmless_path": number(F.coalesce("path", F.lit("")).rlike(HARMLESS_PATH)),
    }
    return found.withColumns({k: F.coalesce(c, F.lit(0.0)) for k, c in features.items()})


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Findings with labels, made by rule from row numbers: half of them real secrets.

    Real: random digests, letters or known forms after a name of secrets or
    alone.  False: placeholders, words, digests and identifiers that say what
    they are, numbers.  Table-free, so the same at every size and place.
    """
    i = F.col("id")
    hexes = F.sha2(F.concat(F.lit("hex"), i), 256)
    letters = F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("abc"), i), 512))), "+/=", "xY7")
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    pick = lambda k, *xs: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    size = (F.pmod(F.xxhash64(i, F.lit("n")), F.lit(28)) + 20).cast("int")
    name = pick("name", "token", "api_key", "password", "secret", "DB_PASSWORD", "access-key", "auth_key")
    assign = F.concat(name, pick("eq", " = ", "=", ": ", '="', ' = "', ': "'))
    prose, code = F.concat(word("a"), F.lit(" "), word("b"), F.lit(" ")), F.concat(word("c"), F.lit(" = "))
    known = pick(
        "known", F.concat(F.lit("sk-"), F.left(letters, F.lit(40))), F.concat(F.lit("ghp_"), F.left(letters, F.lit(36))), F.concat(F.lit("AKIA"), F.upper(F.left(hexes, F.lit(16)))), F.concat(F.lit("xoxb-"), F.left(letters, F.lit(30))),
        F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.repeat(letters, 8), F.lit("\n-----END RSA PRIVATE KEY-----")),
    )
    random = pick("random", F.left(hexes, F.lit(40)), F.left(hexes, F.lit(32)), hexes, F.left(letters, size), F.concat(F.left(letters, F.lit(9)), F.lit("!"), F.left(hexes, F.lit(3))))
    placeholder = F.concat_ws("_", word("p"), word("q"), word("r"), pick("s", "1234", "here", "0000", "example", "xxxx", "2024"))
    said = pick("said", "commit ", "sha256 ", "md5: ", "checksum ", "uuid ", "etag ", "revision ", "image ", "build ")
    number = F.concat(F.lit("20240101"), F.lpad(F.pmod(F.xxhash64(i), F.lit(10**15)).cast("string"), 15, "0"))
    real = F.pmod(i, F.lit(2)) == 1
    kind = F.pmod(F.xxhash64(i, F.lit("kind")), F.lit(8))
    # as people choose them: syllables with digits and signs in them, for short
    sound = lambda k: F.translate(F.substring(letters, k, 5), "0123456789", "aeiouaeiou")
    digits, leet = F.translate(hexes, "abcdef", "123456"), F.translate(sound(3), "aeo", "430")
    chosen = pick(
        "chosen", F.concat(sound(1), F.substring(hexes, 1, 2), sound(7), F.substring(hexes, 3, 1)), F.concat(F.initcap(leet), pick("sign", "!", "&", "#", "$", "@", "%"), F.substring(digits, 1, 3), F.lit(","), F.substring(letters, 20, 4), F.lit("!")),
        F.concat(sound(1), F.lit(";"), sound(7), F.lit(","), F.substring(hexes, 5, 6)), F.concat(F.initcap(sound(2)), F.initcap(leet), F.substring(digits, 5, 4)), F.concat(F.initcap(leet), F.lit("P4ssw0rd"), F.substring(hexes, 9, 2)),
        F.repeat(F.concat(F.lower(sound(1)), F.substring(digits, 7, 1)), 2), F.concat(pick("head", "sk-", "key;", "pw,"), F.lower(sound(2)), F.lit(";"), F.lower(sound(8)), F.lit(","), F.left(F.lit("123456789012345"), F.lit(6)), F.substring(digits, 1, 5)),
    )
    url = F.concat(pick("scheme", "postgres", "https", "redis", "amqp", "mysql+pymysql"), F.lit("://"), pick("user", "admin", "app", "root", "svc-1"), F.lit(":"))
    called = F.concat(word("f"), pick("call", "(config)", "()", "[0]", ".value", "_from_env()"), pick("tail", "", ";", ")"))
    filled = pick("fill", F.lit("${DB_PASSWORD}"), F.lit("<your-password>"), F.lit("{{ secret_value }}"), F.lit("os.environ[name]"), F.lit("$(get_secret)"), F.lit("process.env.TOKEN"))
    alone = real & (kind == 3)
    mixed = F.concat(letters, F.left(hexes, F.lit(8)))
    slashed = pick("alone", F.left(hexes, F.lit(40)), hexes, F.left(letters, F.lit(40)), F.concat_ws("/", F.left(mixed, F.lit(13)), F.substring(mixed, 14, 7), F.substring(mixed, 21, 18)), F.concat_ws("+", F.left(mixed, F.lit(15)), F.substring(mixed, 16, 25)))
    found = (
        F.when(real & (kind < 3), F.concat(assign, random))
        .when(alone, slashed)
        .when(real & kind.isin(6), F.concat(assign, chosen))
        .when(real & kind.isin(7), F.concat(url, F.translate(chosen, "@/;", "xyz")))
        .when(real, known)
        .when(kind == 0, F.concat(assign, placeholder))
        .when(kind == 1, placeholder)
        .when(kind == 2, F.left(hexes, pick("h", 40, 32, 64)))
        .when(kind == 3, number)
        .when(kind == 4, F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)))
        .when(kind == 6, F.concat(assign, F.when(F.pmod(i, F.lit(4)) == 0, called).otherwise(filled)))
        .when(kind == 7, F.concat(url, pick("plain", F.concat(word("p"), word("q")), F.lit("password"), F.lit("changeme"), F.lit("${PASSWORD}"), F.lit("example"))))
        .otherwise(F.concat(assign, F.repeat(pick("rep", "x", "*", "abc", "0", "1234"), 12)))
    )
    told = F.concat(prose, pick("told", "aws key ", "Authorization: Bearer ", "the api key is ", "login with ", "oauth ", "my secret is "))
    before = F.when(alone, told).when(real, pick("before", prose, code, F.lit(""))).when(kind.isin(2, 4), F.concat(prose, said)).otherwise(pick("before2", prose, code))
    path = F.when(real, pick("path", "src1", "config.env", "web/app.py", "src12")).otherwise(pick("path2", "src3", "tests/fixtures.py", "docs/readme", "src9", "app.lock"))
    made = spark.range(n).select(real.cast("double").alias("label"), path.alias("path"), found.alias("found"), before.alias("before"), F.concat(F.lit(" "), word("z")).alias("after"))
    return made.withColumn("value", F.regexp_replace("found", F.concat(F.lit("^"), F.lit(ASSIGNED)), F.lit("")))


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 42, words: tuple[str, ...] = ()) -> RandomForestClassificationModel:
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings, words))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(assembled.select("features", "label").coalesce(1))


def judged(docs: DataFrame, path: str | None = "source", model: RandomForestClassificationModel | None = None, votes: float = VOTES) -> DataFrame:
    """candidates() with the forest's probability and, from `votes` on, `secret`."""
    words = common_words(docs)
    model = model or fit(labelled_findings(docs.sparkSession), words=words)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    found = PipelineModel([assembler, model]).transform(with_features(candidates(docs, path), words))
    chance = F.round(vector_to_array("probability")[1], 6)
    return found.withColumns({"probability": chance, "secret": chance >= votes})


def scan(docs: DataFrame, path: str | None = "source", model: RandomForestClassificationModel | None = None, votes: float = VOTES) -> DataFrame:
    """(doc_id, start, found, value, masked, probability, secret) of each candidate in every whole text.

    secret is what the forest says at `votes`.  Documents without candidates,
    null and empty texts give no rows; a null path counts as empty; repeated
    rows give repeated findings, a null doc_id stays null.
    """
    masked = F.when(F.length("value") <= 8, "****").otherwise(F.concat(F.left("value", F.lit(4)), F.lit("..."), F.right("value", F.lit(4))))
    return judged(docs, path, model, votes).select("doc_id", "start", "found", "value", masked.alias("masked"), "probability", "secret")


def redact(docs: DataFrame, path: str | None = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret's value replaced where it stands, and n_chars, where docs have it, counted anew.

    The verdicts on a text's matches are joined by doc_id, path, both null to
    null, and the text's hash; the text is put together again from its pieces
    and matches.  Rows without secrets stay as they are.
    """
    keys = {"doc_id": "_of_doc", "path": "_of_path", "text_hash": "_of_text"}
    found = judged(docs, path).groupBy(*keys, "nth").agg(F.max("secret").alias("secret"))
    found = found.groupBy(*(F.col(k).alias(v) for k, v in keys.items())).agg(F.array_sort(F.collect_list(F.struct("nth", "secret"))).alias("_verdicts"), F.max("secret").alias("_any")).where("_any").drop("_any")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_of_doc")) & _path(docs, path).eqNullSafe(F.col("_of_path")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_of_text"))
    joined = docs.withColumn("text", F.col("text").cast("string")).join(materialize(found), same, "left")
    hidden = F.zip_with(_hits(), "_verdicts", lambda h, v: F.when(v["secret"], F.concat(F.regexp_extract(h, f"^(?:{ASSIGNED})?", 0), F.lit(mark))).otherwise(h))
    pieces = F.zip_with(_gaps(), hidden, lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
    text = F.when(F.col("_verdicts").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    changed = {"text": text} | ({"n_chars": F.when(F.col("_verdicts").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))} if "n_chars" in docs.columns else {})
    return joined.withColumns(changed).select(docs.columns)
