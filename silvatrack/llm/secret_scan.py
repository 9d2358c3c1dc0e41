"""Secret scans: candidates (long runs of the characters that keys are made of, shorter values behind a key's word, and blocks of
encoded text) go through a random forest over their length, character transitions, dictionary coverage, path and neighbouring
words, which tells secrets from look-alikes.

All of it is DataFrame functions and Spark's own machine-learning library. Labelled findings may be given; without them
the forest learns from findings that documented rules label for sure. Each of these is learned from twice, once with
what the rules decide by masked: so the forest does not repeat the rules, and judges what no rule is sure of by the value
itself, its path and the words near it. A sure finding's label weighs more than the forest's word.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet, unit_hash, written

#: Characters of a run at least.
LEAST = 16
#: Characters on either side of a candidate that are looked at.
CONTEXT = 128
#: How much of a sure finding's probability is its label.
SURE_SHARE = 0.6
#: Characters of a value behind a key's word at least; runs of LEAST key characters in it are candidates of their own.
SHORT = 6
#: About how many labelled findings the forest learns from.
MAX_LABELLED = 20_000
TREES, DEPTH = 20, 8
#: A word is of the dictionary if at least this share of the documents has it, and at least three.
COMMON = 0.0005
#: Letters of a dictionary word.
WORD_LEAST, WORD_MOST = 4, 14
#: Neighbouring words that are looked at on either side, and buckets that they are hashed to.
NEAR_BEFORE, NEAR_AFTER, NEAR_BUCKETS = 3, 2, 64
#: Log-probability of two characters in a row of which one is no letter, or that no dictionary word has.
LEAST_LIKELY = -7.0
#: Probability from which a candidate is a secret.
LEAST_PROBABILITY = 0.5

# Words that stand before a key's value, words of places where look-alikes stand, known forms of keys.
_KEY_NAME = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key|secret[_-]?key)(?:[_-][a-z0-9_-]{1,24})?"
KEY_WORDS = rf"(?i)(?:^|[^a-z]){_KEY_NAME}[\"']?\s*(?:[:=]|=>|is)?\s*[\"']?$"
PLAIN_WORDS = r"(?i)(?:(?:commit|blob|tree|object|parent|etag|integrity|sha\d*|md5|checksum|digest|hash|uuid|guid|revision|example|sample|placeholder|dummy|https?://|www\.|@|id)[\s:=\"'./-]*|base64,|BEGIN (?:CERTIFICATE|[A-Z ]*PUBLIC KEY)-----)$"
#: Behind this, a value is part of an address.
ADDRESS = r"(?i)(?:[a-z][a-z0-9+.-]{1,20}://|www\.)[^\s\"'`<>]*$"
PLAIN_PATHS = r"(?i)(?:test|example|sample|fixture|mock|doc|vendor|third)"
KNOWN_FORMS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35})$"
FILLER = r"^(?:(.)\1+|[xX*0_-]+|(?i:(?:your|my|the|some)[-_]?.*|.*(?:example|placeholder|changeme|dummy).*))$"
CHECKSUM = r"^(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$"
PRIVATE = r"BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY( BLOCK)?-----$"
_KEY = r"[A-Za-z0-9+/_-]"
_VALUE = r"[^\s\"'`<>]"
_KEYED = rf"(?i){_KEY_NAME}[\"']?\s{{0,2}}(?:[:=]|=>)\s{{0,2}}[\"']?"
#: A block of encoded text between lines that say what it is.
_ARMOUR = r"-----BEGIN [A-Z0-9 ]{1,40}-----"
_BODY = r"[\sA-Za-z0-9+/=:,.-]"

#: Columns of the value, and of what stands around it.
VALUE_FEATURES = ["length", "digits", "changes", "entropy", "likely", "covered", "recurs"]
PLACE_FEATURES = ["keyed", "plain", "quoted", "assigned", "path_plain", "path_depth", "path_digits", "path_rate"]
FEATURES = VALUE_FEATURES + PLACE_FEATURES


def _places(rows: DataFrame, text: str, cut: str, keep: str, context: int, near: int, least: int = LEAST, first: int = 0) -> DataFrame:
    """rows, without text, for each piece of text, of those from first on, that begins with keep and has least bytes, text being
    cut where cut matches nothing wide: c is its value, pos (from 1), and what stands before and after it, taken from near
    pieces on either side (enough to hold context)."""
    others = [c for c in rows.columns if c != text]
    # explode keeps what is cut out from being worked out again for each piece.
    cuts = rows.select(*others, F.explode(F.array(F.split(text, cut))).alias("pieces"))
    cuts = cuts.select("*", F.explode(F.array(F.transform("pieces", F.char_length))).alias("sizes"))
    add = lambda sizes: F.aggregate(sizes, F.lit(0), lambda x, y: x + y)
    steps = F.transform(F.sequence(F.lit(0), (F.size("sizes") / 64).cast("int")), lambda i: add(F.slice("sizes", i * 64 + 1, F.lit(64))))
    cuts = cuts.select("*", F.explode(F.array(steps)).alias("steps"))

    def piece(x: Column, i: Column) -> Column:
        whole = (i / 64).cast("int")
        pos = add(F.slice("steps", F.lit(1), whole)) + add(F.slice("sizes", whole * 64 + 1, i - whole * 64)) + 1
        begin = F.greatest(F.lit(0), i - near)
        before = F.right(F.array_join(F.slice("pieces", begin + 1, i - begin), ""), F.lit(context))
        after = F.left(F.array_join(F.slice("pieces", i + 2, F.lit(near)), ""), F.lit(context))
        return F.struct(x.alias("value"), pos.alias("pos"), before.alias("before"), after.alias("after"), i.alias("nth"))

    found = F.filter(F.transform("pieces", piece), lambda c: (c["nth"] >= first) & (F.octet_length(c["value"]) >= least) & c["value"].rlike("^" + keep))
    return cuts.select(*others, F.explode(found).alias("c"))


def candidates(documents: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(doc_id, text_key, path, pos, value, before, after): each text's values that may be secrets, at each of their places (from 1),
    with up to context characters on either side.

    A value is a run of at least LEAST key characters, with up to two = for padding; an = with more behind it ends a run, so that
    a name before it is no part of the value. A run with / in it is cut there, and its parts of LEAST characters are values,
    as those of a path are; it is one value where it is quoted, assigned to a name, or what a data address encodes. Behind a
    key's word and : or =, other values of at least SHORT characters, up to white space or a quote, are values too. A block
    between a BEGIN and an END line is one value, and what is in it none. All of this holds at any length. Rows that share
    doc_id and text have the same candidates, and get them once."""
    names = ["doc_id", "text_key", "path", "pos", "value", "before", "after"]
    base = documents.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("source", F.lit("")).alias("path"), "text")
    blocks = _places(base.filter(F.col("text").rlike(_ARMOUR)), "text", f"(?<={_ARMOUR})(?={_BODY})|(?=-----END )", f"{_BODY}{{{LEAST}}}", context, 1, LEAST, 1).select("doc_id", "text_key", "path", "c.*")
    blocks = written(blocks.filter(F.col("before").rlike(f"{_ARMOUR}$")).select(*names))
    inside = blocks.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(F.col("pos").alias("lo"), (F.col("pos") + F.char_length("value")).alias("hi"))).alias("spans"))

    def free(found: DataFrame) -> DataFrame:
        """found without what stands in a block."""
        within = found.join(inside.withColumnsRenamed({"doc_id": "d", "text_key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
        return within.filter(F.col("spans").isNull() | ~F.exists("spans", lambda s: (F.col("pos") >= s["lo"]) & (F.col("pos") < s["hi"]))).select(*names)

    keyed = base.filter(F.col("text").rlike(f"{_KEYED}{_VALUE}{{{SHORT}}}"))
    short = _places(keyed, "text", f"(?<={_KEYED})(?={_VALUE}{{{SHORT}}})", f"{_VALUE}{{{SHORT}}}", context, 1, SHORT, 1).select("doc_id", "text_key", "path", "c.*")
    # Marks at a value's end belong to the sentence.
    short = short.withColumn("piece", F.col("value")).withColumn("value", F.regexp_extract("piece", f"^{_VALUE}{{{SHORT - 1},}}(?<![.,;:)\\]}}])", 0))
    short = short.withColumn("after", F.left(F.concat(F.substr("piece", F.char_length("value") + 1), "after"), F.lit(context)))
    short = short.filter((F.char_length("value") >= SHORT) & ~F.col("value").rlike(f"{_KEY}{{{LEAST}}}")).select(*names)
    rows = base.filter(F.col("text").rlike(f"{_KEY}{{{LEAST}}}"))
    ends = f"(?<!{_KEY})(?={_KEY}{{{LEAST}}})|(?!{_KEY})(?<={_KEY}{{{LEAST}}})"
    found = _places(rows, "text", ends, f"{_KEY}{{{LEAST}}}", context, 4 * math.ceil(context / 32)).select("doc_id", "text_key", "path", "c.*").select(*names)
    padding = F.regexp_extract("after", r"^={1,2}(?![A-Za-z0-9+/=_-])", 0)
    found = found.withColumn("value", F.concat("value", padding)).withColumn("after", F.substr("after", F.char_length(padding) + 1)).distinct()
    quoted = F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")
    assigned = F.col("before").rlike(r"[A-Za-z0-9_.-][\"']?\s{0,2}(?:[:=]|=>)\s{0,2}[\"'`]?$") | F.col("before").rlike(r"base64,$") | F.col("before").rlike(KEY_WORDS)
    cut = F.col("value").contains("/") & ~((quoted | assigned) & ~F.col("before").rlike(ADDRESS))
    found = written(free(found).withColumn("cut", cut))
    outer = ["doc_id", "text_key", "path", F.col("pos").alias("at"), F.col("before").alias("left"), F.col("after").alias("right")]
    parts = _places(found.filter("cut").select(*outer, "value"), "value", "(?<=/)(?=[^/])|(?<=[^/])(?=/)", "[^/]", context, context)
    parts = parts.select(
        "doc_id", "text_key", "path", "c.value", (F.col("at") + F.col("c.pos") - 1).alias("pos"),
        F.right(F.concat("left", "c.before"), F.lit(context)).alias("before"), F.left(F.concat("c.after", "right"), F.lit(context)).alias("after"),
    )
    return found.filter("NOT cut").select(*names).unionByName(parts.select(*names)).unionByName(free(short)).unionByName(blocks).distinct()


def letter_runs(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.octet_length(w).between(WORD_LEAST, WORD_MOST))


def dictionary(documents: DataFrame) -> DataFrame:
    """(word, n): runs of letters that many documents have, and how many; counted over all of them."""
    n = documents.count()
    found = documents.select(F.explode(F.array_distinct(letter_runs(F.col("text")))).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(3, COMMON * n))


def transitions(words: DataFrame) -> Column:
    """An array with, at 26 times one letter's number and another's, the log-probability of the second behind the first in the
    dictionary's words."""
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    counts = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    totals: dict[str, int] = {}
    for p, n in counts.items():
        totals[p[0]] = totals.get(p[0], 0) + n
    letters = "abcdefghijklmnopqrstuvwxyz"
    cells = [max(LEAST_LIKELY, math.log(counts[a + b] / totals[a])) if a + b in counts else LEAST_LIKELY for a in letters for b in letters]
    return F.array(*[F.lit(c) for c in cells])


def featurise(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with the columns of FEATURES and near, the neighbouring words with their places. changes and likely are of the
    characters' transitions: how often their class changes, and the mean log-probability of two in a row in the dictionary's
    words; covered is the share of characters in such words; recurs, the log of how many documents have the value; path_rate,
    the candidates of the source for each of its documents with any."""
    count = lambda c, pattern: F.char_length(F.regexp_replace(c, pattern, ""))
    v, n = F.col("value"), F.char_length("value").cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "b"), "[0-9]+", "c"), r"[^abc]+", "d")
    likely = transitions(words)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)

    def entropy(c: Column) -> Column:
        share = F.transform(F.array_distinct(c), lambda x: F.size(F.filter(c, lambda y: y == x)) / F.size(c))
        return -add(F.transform(share, lambda p: p * F.log2(p)))

    def mean_likely(c: Column) -> Column:
        both = lambda a, b: F.when(a.between("a", "z") & b.between("a", "z"), F.get(likely, 26 * (F.ascii(a) - 97) + F.ascii(b) - 97)).otherwise(LEAST_LIKELY)
        each = F.transform(c, lambda x, i: F.when(i > 0, both(F.get(c, i - 1), x)).otherwise(0.0))
        return add(each) / F.greatest(F.size(c) - 1, F.lit(1))

    # Hashes go along with the words, not the values, which may be long.
    values = found.select(F.xxhash64("value").alias("value_key"), F.array_distinct(letter_runs(F.regexp_replace(v, "([a-z])([A-Z])", "$1 $2"))).alias("parts"))
    parts = values.select("value_key", F.explode("parts").alias("word")).distinct()
    known = parts.join(words.select("word"), "word").groupBy("value_key").agg(F.sum(F.char_length("word")).alias("in_words"))
    keyed = found.withColumn("value_key", F.xxhash64("value"))
    often = keyed.groupBy("value_key").agg(F.log2(F.count_distinct(F.struct("doc_id", "text_key"))).alias("recurs"), F.count(F.lit(1)).alias("weight"))
    facts = written(often.join(known, "value_key", "left"))
    rates = written(found.groupBy("path").agg((F.count(F.lit(1)) / F.count_distinct(F.struct("doc_id", "text_key"))).alias("path_rate"), F.count(F.lit(1)).alias("weight")))
    near = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != "")
    placed = lambda c, mark: F.transform(c, lambda w, i: F.concat(F.lit(mark), i.cast("string"), F.lit(":"), w))
    behind = F.slice(F.reverse(near(F.col("before"))), 1, NEAR_BEFORE)
    return (
        meet(meet(keyed, facts, ["value_key"], "weight"), rates, ["path"], "weight")  # a value or a path that very many rows have is no one task's
        .withColumn("chars", F.split(F.lower(v), ""))
        .withColumn("length", F.log2(n)).withColumn("digits", count(v, "[^0-9]") / n).withColumn("changes", F.char_length(kinds) / n)
        .withColumn("entropy", entropy(F.col("chars"))).withColumn("likely", mean_likely(F.col("chars")))
        .withColumn("covered", F.least(F.lit(1.0), F.coalesce("in_words", F.lit(0)) / n))
        .withColumn("keyed", F.col("before").rlike(KEY_WORDS).cast("double")).withColumn("plain", (F.col("before").rlike(PLAIN_WORDS) | F.col("before").rlike(ADDRESS)).cast("double"))
        .withColumn("quoted", (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"))
        .withColumn("assigned", F.col("before").rlike("[:=>]\\s*[\"'`]?$").cast("double"))
        .withColumn("path_plain", F.col("path").rlike(PLAIN_PATHS).cast("double")).withColumn("path_depth", F.size(F.split("path", "[/.]")).cast("double"))
        .withColumn("path_digits", count(F.col("path"), "[^0-9]").cast("double")).withColumn("path_rate", F.coalesce("path_rate", F.lit(0.0)).cast("double"))
        .withColumn("near", F.concat(placed(behind, "b"), placed(F.slice(near(F.col("after")), 1, NEAR_AFTER), "a"), placed(F.slice(near(F.col("path")), 1, 4), "p")))
        .drop("in_words", "value_key", "chars")
    )


def rule_labels(found: DataFrame) -> Column:
    """1.0 for findings that are secrets for sure, 0.0 for those that are none, else null. Sure secrets: known forms, blocks of
    private keys, and values of digits and letters behind a key's word that are quoted or stand right behind its = or :. Sure
    look-alikes: filler, words of the dictionary, and, not behind a key's word, letters alone, digits alone, hexadecimal
    digits as many as a checksum has, and what stands behind words of checksums, ids and addresses."""
    v, before = F.col("value"), F.col("before")
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(FILLER)
    tight = (F.col("quoted") == 1) | before.rlike("[:=]$")
    alone = v.rlike("^[A-Za-z_/=+-]+$") | v.rlike("^[0-9_/=+-]+$") | v.rlike(CHECKSUM) | (F.col("plain") == 1)
    sure = v.rlike(KNOWN_FORMS) | before.rlike(PRIVATE) | ((F.col("keyed") == 1) & tight & mixed)
    return F.when(sure & ~((F.col("plain") == 1) & before.rlike(r"BEGIN|base64,$")), 1.0).when(v.rlike(FILLER) | (F.col("covered") >= 0.8) | ((F.col("keyed") == 0) & alone), 0.0)


def _vectors(found: DataFrame) -> DataFrame:
    hashed = HashingTF(inputCol="near", outputCol="near_hash", numFeatures=NEAR_BUCKETS, binary=True).transform(found)
    return VectorAssembler(inputCols=[*FEATURES, "near_hash"], outputCol="features").transform(hashed)


def masked(found: DataFrame) -> DataFrame:
    """found without what the rules decide by: as if nothing stood around its values, and no word were in the dictionary."""
    return found.withColumns({c: F.lit(0.0) for c in [*PLACE_FEATURES, "covered"]}).withColumn("near", F.array().cast("array<string>"))


def fit(found: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 4) -> RandomForestClassificationModel | None:
    """found has FEATURES, near and label (1.0, 0.0, null: unlabelled). None if a class has no findings. Findings are chosen by
    hashes of their values, each class up to half of max_labelled or so; each counts once as it is and once masked."""
    counts = {r["label"]: r["n"] for r in found.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("label") == 1.0, min(1.0, max_labelled / 2 / counts[1.0])).otherwise(min(1.0, max_labelled / 2 / counts[0.0]))
    chosen = found.filter(F.col("label").isNotNull() & (unit_hash("value", "doc_id", F.lit(seed)) < share))
    weight = F.when(F.col("label") == 1.0, 1.0 / counts[1.0]).otherwise(1.0 / counts[0.0]) * min(counts.values())
    chosen = chosen.withColumn("weight", F.greatest(weight, F.lit(1e-3))).select(*FEATURES, "near", "label", "weight")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, weightCol="weight", featureSubsetStrategy="onethird", maxMemoryInMB=64)
    return forest.fit(_vectors(chosen.unionByName(masked(chosen))).select("features", "label", "weight"))


def kept_out(seed: int = 9) -> Column:
    """A fifth of the documents, by a hash of their texts."""
    return F.pmod(F.xxhash64("text_key", F.lit(seed)), F.lit(5)) == 0


def quality(found: DataFrame, mask: bool = False) -> dict[str, float]:
    """How a forest that learns from four fifths of the documents judges the labelled findings of the others: precision,
    recall, and how many these are. With mask, what the rules decide by is not shown to it."""
    model = fit(found.withColumn("label", F.when(~kept_out(), F.col("label"))))
    rest = found.filter(kept_out() & F.col("label").isNotNull())
    judged = model.transform(_vectors(masked(rest) if mask else rest)).withColumn("said", F.get(vector_to_array("probability"), F.lit(1)) >= LEAST_PROBABILITY)
    r = judged.agg(F.count_if(F.col("said") & (F.col("label") == 1)).alias("hit"), F.count_if("said").alias("said"), F.count_if(F.col("label") == 1).alias("true"), F.count(F.lit(1)).alias("n")).first()
    return {"precision": r["hit"] / max(1, r["said"]), "recall": r["hit"] / max(1, r["true"]), "n": r["n"]}


def judge(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, pos, value, label, probability, secret): every candidate at each of its places. labelled, if given, has value and label
    (1.0 or 0.0) and takes the place of the rules. Without findings of both classes the probability is the label's, 0.5
    where there is none."""
    documents = documents.filter(F.col("text").isNotNull())
    found = labelled_findings(documents, labelled)
    model = fit(found)
    if model is None:
        judged = found.withColumn("probability", F.coalesce("label", F.lit(0.5)))
    else:
        forest = F.get(vector_to_array("probability"), F.lit(1))
        judged = model.transform(_vectors(found)).withColumn("probability", F.when(F.col("label").isNull(), forest).otherwise(SURE_SHARE * F.col("label") + (1 - SURE_SHARE) * forest))
    return judged.select("doc_id", "text_key", "pos", "value", "label", "probability", (F.col("probability") >= LEAST_PROBABILITY).alias("secret"))


def labelled_findings(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate of documents at each of its places, with its features and its label: a given one, or the rules'."""
    found = featurise(written(candidates(documents)), written(dictionary(documents)))
    if labelled is None:
        # A place by which a value would be none does not count where another place shows that it is a secret.
        found = written(found.withColumn("label", rule_labels(found)))
        keyed = found.withColumn("value_key", F.xxhash64("value"))
        sure = written(keyed.groupBy("value_key").agg(F.coalesce(F.max("label") == 1.0, F.lit(False)).alias("sure"), F.count(F.lit(1)).alias("weight")))
        found = meet(keyed, sure, ["value_key"], "weight").withColumn("label", F.when(F.col("label") == 1.0, 1.0).when(~F.col("sure"), F.col("label"))).drop("sure", "value_key")
    else:
        found = found.join(labelled.groupBy("value").agg(F.max(F.col("label").cast("double")).alias("label")), "value", "left")
    return written(found)


def scan(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Of each row: doc_id, n_candidates, n_secrets (distinct values, secret at any of their places), first_secret (the first such place, null if none),
    secrets_sha256 (of the secrets, sorted and newline-joined; of nothing if none) and score (the largest probability, 0 if
    there are no candidates; a source, or a table, without findings of both classes gets their labels, 0.5 where there is
    none). Ties go to the first place.

    Null and empty texts have no candidates. Rows that repeat give a row each; null ids and sources are like any other.
    Whole texts are scanned; further columns are not looked at.
    """
    documents = documents.select("doc_id", "text", "source")
    by = judge(documents, labelled).groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(
        F.size(F.collect_set("value")).cast("long").alias("n_candidates"), F.size(F.collect_set(F.when(F.col("secret"), F.col("value")))).cast("long").alias("n_secrets"), F.min(F.when(F.col("secret"), F.col("pos"))).cast("long").alias("first_secret"),
        F.array_sort(F.collect_set(F.when(F.col("secret"), F.col("value")))).alias("values"), F.max("probability").alias("score"),
    )
    base = documents.select("doc_id", F.xxhash64("text").alias("text_key"))
    joined = base.join(by, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", F.coalesce("n_candidates", zero).alias("n_candidates"), F.coalesce("n_secrets", zero).alias("n_secrets"), "first_secret",
        F.sha2(F.coalesce(F.array_join("values", "\n"), F.lit("")), 256).alias("secrets_sha256"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
