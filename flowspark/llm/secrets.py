"""Secret scan: candidate strings, and a random forest that removes false positives.

Column expressions only. Candidates are values of any length assigned to a secret's name, private keys in PEM form, dotted
keys, and runs of 16 or more letters, digits and ``+/_-``. Each gets features of its length, character transitions, dictionary
coverage, path and neighbouring words; the forest is trained on labelled findings and
compiled into one column expression that runs inside the row, so texts are neither shuffled nor exploded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import trees
from flowspark.session import durable

NAME = r"token|secret|passw|pwd|passphrase|passcode|api.?key|access.?key|auth(?!or)|authori[sz]|bearer|credential|private"
_RUN = r"[\p{L}\p{N}+/_\-]{16,}"
_KEY_LINE = "[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
# without an end the lines that look like a key
_PEM = rf"-----BEGIN {_KEY_LINE}(?:[A-Za-z0-9+/=\s\\:,.()\-]{{0,65536}}?-----END {_KEY_LINE}|(?:\s+[A-Za-z0-9+/=]{{16,}}){{0,400}})"
_DOTTED = (
    r"(?<![\p{L}\p{N}])(?:SG\.[\w\-]{16,}\.[\w\-]{16,}|eyJ[\w\-]{8,}\.[\w\-]{8,}(?:\.[\w\-]+){0,3}|[\w\-]{23,28}\.[\w\-]{6,7}\.[\w\-]{27,})"
    rf"|{_RUN}(?:\.{_RUN}){{0,8}}"
)
#: A secret's name, the sign of an assignment and an opening quote.
ASSIGN = (
    r"(?<![\p{L}\p{N}_])(?=[\w.\- ]{0,60}[\"'`]?\s{0,5}[=:])(?=(?i:(?:api|access|private|secret|auth) |[\w.\-]{0,60}?(?:" + NAME + r")))"
    r"(?i:(?:api|access|private|secret|auth) )?[\w.\-]{1,60}[\"'`]?\s{0,5}(?::=|=>|={1,3}|:)\s{0,5}[\"'`]?(?i:(?:bearer|basic|token)\s+)?"
)
_QUOTED = "|".join(rf"(?<={q})(?=[^{q}\s])[^{q}\s\\]*+(?:\\\S[^{q}\s\\]*+){{0,500}}" for q in "\"'`")
_ASSIGNED = rf"(?:{_PEM}|{_QUOTED}|[^\s\"'`]*[^\s\"'`,;)\]}}])"
_BARE = rf"{_PEM}|{_DOTTED}"
CANDIDATE = rf"{ASSIGN}{_ASSIGNED}|{_BARE}"
#: How keys of known services begin.
KNOWN = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk_live_|rk_live_|AIza|glpat-|npm_|SG\.|eyJ[\w\-]+\.|-----BEGIN )"
#: Characters of context on either side of a candidate.
REACH = 120

# Frequent syllables of English, French, German and Spanish; strings they cover are words, not keys.
DICTIONARY = (
    "tion", "ment", "ciones", "mente", "ción", "schaft", "keit", "heit", "ung", "lich", "ich", "ein", "sch", "der", "die", "und", "den",
    "the", "and", "ing", "ent", "ion", "for", "that", "with", "this", "are", "was", "ble", "est", "ers", "ted", "her", "his", "ous",
    "que", "les", "des", "eau", "aux", "eux", "elle", "oir", "ais", "ait", "ans", "par", "pour", "los", "las", "del", "ado", "ada",
    "con", "por", "una", "res", "ter", "ver", "ber", "gen", "ten", "zu", "be", "ge", "er", "en", "es", "re", "on", "an", "in", "th",
    "nd", "st", "nt", "at", "ou", "ha", "ti", "al", "is", "or", "as", "to", "it", "ed", "ea", "he", "ly", "wh", "sh", "of",
)

FEATURES = (
    "length", "digit_share", "upper_share", "transitions", "distinct_share", "hex_only", "plain_letters", "dictionary_share",
    "key_word", "assigned", "quoted", "known_prefix", "harmless_word", "test_path", "path_depth", "symbol_share", "expression",
)


def _features(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Numeric features of one candidate; a null path has depth 0."""
    n = F.length(value)
    share = lambda pattern: (n - F.length(F.regexp_replace(value, pattern, ""))) / n
    low = F.lower(value)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{Lu}", "A"), r"[\p{L}&&[^A]]", "a"), r"\p{N}", "0")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": n.cast("double"),
        "digit_share": share(r"\p{N}"),
        "upper_share": share(r"\p{Lu}"),
        # places where the class of the next character differs
        "transitions": F.regexp_count(classes, F.lit("(?=a[^a]|A[^A]|0[^0]|[^aA0][aA0])")) / n,
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hex_only": flag(low.rlike("^[0-9a-f]+$")),
        "plain_letters": flag(value.rlike(r"^\p{L}+$")),
        "dictionary_share": (n - F.length(F.regexp_replace(low, "|".join(DICTIONARY), ""))) / n,
        "key_word": flag(F.lower(before).rlike(rf"({NAME})([^\n]{{0,12}}|[\w.\-]{{0,60}}[\"'`]?\s{{0,5}}[=:]+>?\s{{0,5}}[\"'`]?((bearer|basic|token)\s+)?)$")),
        "assigned": flag(F.lower(before).rlike(r"[=:]>?\s*[\"'`]?((bearer|basic|token)\s+)?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "known_prefix": flag(value.rlike(KNOWN)),
        "harmless_word": flag(F.lower(before).rlike(r"(commit|sha-?[0-9]*|md5|checksum|hash|digest|uuid|guid|href|src|integrity|etag|version|example)[^\n]{0,12}$")),
        "test_path": flag(F.lower(path).rlike(r"(^|[/_.-])(test|tests|example|examples|fixture|fixtures|mock|sample|docs?)([/_.-]|$)")),
        "path_depth": F.coalesce(F.size(F.split(path, "/")), F.lit(0)).cast("double"),
        "symbol_share": share(r"[^\p{L}\p{N}+/_\-\s]"),
        # a name with dots, a call, a placeholder, an address, a word of a programming language
        "expression": flag(value.rlike(r"^\p{L}\w*(\.\p{L}\w*)+([(\[].*)?$|^\p{L}\w*[(\[].*$|^[$%]?[({<\[]|^[$%]\w+%?$|^[*.xX]+$|^https?://[^@]*$|(?i)^(null|none|nil|true|false|undefined|str|string|bytes|int|changeme)$")),
    }


def _looked_for(text: Column, use) -> Column:
    """``use(pattern)``: only texts with a sign of assignment are searched for assignments, which is most of the work."""
    return F.when(text.rlike("[=:]"), use(CANDIDATE)).otherwise(use(_BARE))


def _found(text: Column) -> Column:
    """The candidates, each with the name and sign it is assigned by."""
    return _looked_for(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))


def _between(text: Column) -> Column:
    """The texts around what is found, one more than these."""
    return _looked_for(text, lambda p: F.split(text, p, -1))


def _lead(found: Column) -> Column:
    """The name and sign of an assignment, "" without one."""
    return F.regexp_extract(found, rf"\A({ASSIGN})(?={_ASSIGNED}\z)", 1)


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def candidates(text: Column, path: Column | None) -> Column:
    """Array of structs (value, before, after, lead, features) of all candidates of a text, in order; null where there is none.

    Without a path column the features are left out.
    ``before`` and ``after`` are the text on either side, over at least two other candidates; ``lead`` is the part of
    ``before`` that was found with the value.
    """
    none, empty = F.lit(""), lambda k: F.array(*[F.lit("")] * k)

    def surrounded(s: Column) -> Column:
        found, gaps = s["found"], s["gaps"]
        n = F.size(found)
        shifted = {f"{name}{k}": F.concat(empty(k), a) for k in (1, 2) for name, a in (("f", found), ("g", gaps))}
        ahead = {f"{name}{k}": F.slice(a, 1 - k, n) for k in (-1, -2) for name, a in (("f", found), ("g", gaps))}
        named = {"f": found, "g": gaps, **shifted, **{k.replace("-", "_"): v for k, v in ahead.items()}}
        zipped = F.slice(F.arrays_zip(*[v.alias(k) for k, v in named.items()]), 1, n)

        def one(x: Column) -> Column:
            part = lambda k: F.coalesce(x[k], none)
            tail = lambda k: F.right(part(k), F.lit(REACH))
            head = lambda k: F.left(part(k), F.lit(REACH))
            before = F.concat(tail("g2"), tail("f2"), tail("g1"), tail("f1"), tail("g"))
            after = F.left(F.concat(head("g_1"), head("f_1"), head("g_2"), head("f_2")), F.lit(REACH))
            return _with(_lead(part("f")), lambda lead: F.struct(
                F.substr(part("f"), F.length(lead) + 1).alias("value"), F.right(F.concat(before, lead), F.lit(REACH)).alias("before"), after.alias("after"), lead.alias("lead")
            ))

        return F.transform(zipped, one)

    found = _with(F.struct(_found(text).alias("found"), _between(text).alias("gaps")), surrounded)
    if path is None:
        return F.when(_looked_for(text, text.rlike), found)
    full = F.transform(
        found,
        lambda x: F.struct(x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"), x["lead"].alias("lead"),
                           *[c.alias(k) for k, c in _features(x["value"], x["before"], x["after"], path).items()]),
    )
    return F.when(_looked_for(text, text.rlike), full)


@dataclass(frozen=True)
class SecretModel:
    forest: tuple[trees.Split | float, ...]
    threshold: float = 0.5

    def score(self, finding: Column) -> Column:
        """Share of the trees that vote for a secret."""
        total = F.lit(0.0)
        for tree in self.forest:
            total = total + trees.vote(tree, lambda i: finding[FEATURES[i]])
        return total / max(len(self.forest), 1)


def labelled_findings(spark: SparkSession, n: int = 1200) -> DataFrame:
    """(value, before, after, path, label): 2 n findings of each label, made from hashes by a rule.

    Secrets: keys with known prefixes, and hexadecimal or base-64 strings that are assigned to a secret's name; short keys and
    passwords with digits and signs assigned so; dotted keys and private keys in PEM form. Others: long words of the
    dictionary's syllables, hashes and ids beside their names, words joined by dashes; words, numbers, calls, placeholders
    and addresses assigned to a secret's name.
    """
    d = F.array(*[F.lit(x) for x in DICTIONARY])
    i = F.col("id")
    hexes, base = F.sha2(i.cast("string"), 256), F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i.cast("string")), 256))), "=+/", "xYz")
    upper = F.translate(F.upper(F.sha2(F.concat(F.lit("u"), i.cast("string")), 256)), "0189", "QXZW")
    pick = lambda salt, options: F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in options]), F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(options))).cast("int"))
    word = F.array_join(F.transform(F.sequence(F.lit(1), 6 + F.pmod(F.xxhash64(i, F.lit(9)), F.lit(7)).cast("int")), lambda k: F.get(d, F.pmod(F.xxhash64(i, k), F.lit(len(DICTIONARY))).cast("int"))), "")
    name = pick(1, ["token", "password", "secret", "api_key", "access_key", "auth_token", "client_secret", "passwd"])
    link = pick(2, [" = \"", "=", ": \"", ": ", " = '", ":"])
    size = F.get(F.array(*[F.lit(x) for x in (16, 18, 20, 24, 32, 40, 40, 64)]), F.pmod(F.xxhash64(i, F.lit(3)), F.lit(8)).cast("int"))
    text_word = pick(4, ["the ", "and then ", "der ", "le ", "los ", "is\n", ""])
    keyed = F.concat(pick(5, ["AKIA", "ASIA"]), F.substring(upper, 1, 16))
    short = lambda c: c.substr(F.lit(1), size)
    made = spark.range(0, 2 * n, 1, 2).select(
        (i % 2).cast("double").alias("label"),
        F.when(i % 2 == 1, pick(6, [keyed, short(hexes), short(hexes), short(base)])).otherwise(
            pick(7, [word, word, word, F.initcap(word), short(hexes), F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 12)), F.concat(F.substring(word, 1, 8), F.lit("-"), word),
                     F.repeat(pick(11, ["-", "_", "/", "a", "0", "x", "A"]), 24), F.concat(F.lit("usr/local/"), word, F.lit("/"), F.substring(word, 1, 5))])
        ).alias("value"),
        F.concat(text_word, F.concat(name, link)).alias("assign"), text_word.alias("plain"),
        F.concat(text_word, pick(8, ["commit ", "sha256: ", "checksum ", "uuid=", "md5 ", "etag: \""])).alias("harmless"),
        pick(10, ["src/main/app.py", "config/settings.yml", "data", "tests/test_app.py", "a/b/c/d.txt"]).alias("path"),
    )
    secret, known, hashed = F.col("label") == 1, F.col("value").rlike("^(AKIA|ASIA)"), F.col("value").rlike(r"^[0-9a-f\-]+$")
    before = F.when(secret & known, F.when(F.hash("value") % 3 == 0, F.col("assign")).otherwise(F.col("plain"))).when(secret, F.col("assign")).when(hashed, F.col("harmless")).otherwise(F.col("plain"))
    after = lambda c: F.when(c.rlike("[\"']$"), F.right(c, F.lit(1))).otherwise(" ").alias("after")
    long = made.select("value", before.alias("before"), after(before), "path", "label").filter(F.length("value") >= 16)
    few = 8 + F.pmod(F.xxhash64(i, F.lit(12)), F.lit(8)).cast("int")
    sign, number = pick(13, [*"!@#$.%&*?"]), F.pmod(F.xxhash64(i, F.lit(14)), F.lit(10_000)).cast("string")
    start = F.substring(word, 1, 6)
    passwords = [F.concat(start, number, sign), F.concat(start, number, sign, F.substring(base, 1, 1)), F.concat(start, sign, F.substring(word, 4, 4), number), F.concat(F.initcap(start), number),
                 F.concat(F.substring(base, 1, 5), sign, F.substring(base, 7, 4)), F.concat(F.initcap(start), sign, F.substring(word, 3, 5))]
    key_kind = pick(15, ["RSA ", "EC ", "", "OPENSSH "])
    pem = F.concat(F.lit("-----BEGIN "), key_kind, F.lit("PRIVATE KEY-----\nMII"), F.repeat(F.concat(base, F.lit("\n")), 5), F.lit("-----END "), key_kind, F.lit("PRIVATE KEY-----"))
    dotted = [F.concat(F.lit("eyJ"), F.substring(base, 1, 24), F.lit("."), hexes, F.lit("."), base), F.concat(F.lit("SG."), F.substring(base, 1, 22), F.lit("."), base)]
    keys = [hexes.substr(F.lit(1), few), base.substr(F.lit(1), few)]
    harmless = [start, F.substring(word, 1, 3), word, F.initcap(start), F.substring(number, 1, 3), F.concat(start, F.lit("."), F.substring(word, 3, 5)), F.concat(F.lit("get_"), start, F.lit("()")),
                F.lit("os.environ["), F.concat(F.lit("${"), F.upper(start), F.lit("}")), F.concat(F.lit("<"), start, F.lit(">")), F.lit("None"), F.lit("null"), F.lit("********"),
                F.concat(F.lit("https://"), start, F.lit(".org/"), number), F.concat_ws("-", start, F.substring(word, 3, 5), F.substring(word, 2, 4))]
    secret = F.col("label") == 1
    other = spark.range(2 * n, 4 * n).select(
        (i % 2).cast("double").alias("label"), F.when(i % 2 == 1, pick(16, [*passwords, *keys, *keys, *dotted, pem])).otherwise(pick(17, harmless)).alias("value"),
        F.concat(text_word, name, link).alias("assign"), text_word.alias("plain"), pick(10, ["src/main/app.py", "config/settings.yml", "data", "tests/test_app.py", "a/b/c/d.txt"]).alias("path"),
    )
    free = F.col("value").rlike(r"^(eyJ|SG\.|-----)") & (F.hash("value") % 2 == 0)
    before = F.when(secret & free, F.col("plain")).otherwise(F.col("assign"))
    return long.unionByName(other.select("value", before.alias("before"), after(before), "path", "label"))


def label_by_rule(findings: DataFrame) -> DataFrame:
    """Label candidates of a corpus where a rule is sure of them, for training; the unsure ones are left out."""
    sure = (F.col("known_prefix") == 1) | ((F.col("key_word") == 1) & (F.col("assigned") == 1) & (F.col("digit_share") > 0.15) & (F.col("length") >= 8) & (F.col("expression") == 0) & (F.col("harmless_word") == 0))
    never = (F.col("plain_letters") == 1) & (F.col("dictionary_share") > 0.6) & (F.col("key_word") == 0)
    return findings.withColumn("label", F.when(sure, 1.0).when(never, 0.0)).filter("label is not null")


def fit(labelled: DataFrame, n_trees: int = 25, depth: int = 5, threshold: float = 0.5, seed: int = 11) -> SecretModel:
    """Forest over findings with the feature columns and ``label`` (0 or 1). Without one of the classes nothing is a secret
    (no label 1) or everything is (no label 0); without rows nothing is."""
    rows = durable(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled).select("features", "label").repartition(4))
    seen = {r[0] for r in rows.select("label").distinct().collect()}
    if len(seen) < 2:
        return SecretModel((float(1.0 in seen),), threshold)
    forest = RandomForestClassifier(numTrees=n_trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)
    return SecretModel(tuple(trees.read_tree(t.toDebugString) for t in forest.trees), threshold)


def featured(findings: DataFrame) -> DataFrame:
    """Findings as rows (value, before, after, path, ...) with their feature columns."""
    made = _features(F.col("value"), F.col("before"), F.col("after"), F.col("path"))
    return findings.select("*", *[c.alias(k) for k, c in made.items()])


def train(docs: DataFrame, text_col: str = "text", path_col: str = "source", max_findings: int = 20_000, seed: int = 11, **options) -> SecretModel:
    """Fit on the made findings and on at most ``max_findings`` rule-labelled findings of the documents.

    The bound takes the findings with the smallest hashes, each distinct (value, before) once. Candidates that the rule
    can't label by their kind are left out first, and features are made for the four times ``max_findings`` that come first.
    """
    path = F.col(path_col).cast("string")
    # an outer explode: the filter that is inferred for others would look for all candidates once more
    found = docs.select(path.alias("path"), F.explode_outer(candidates(F.col(text_col).cast("string"), None)).alias("f")).filter("f is not null").select("path", "f.*")
    kind = (F.col("lead") != "") | F.col("value").rlike(rf"{KNOWN}|^\p{{L}}+$") | F.lower("before").rlike("[=:]")
    order = F.xxhash64(F.lit(seed), "value", "before")
    first = found.filter(kind).groupBy("value", "before").agg(F.min("after").alias("after"), F.min("path").alias("path"))
    first = first.select("*", order.alias("_o")).orderBy("_o", "value", "before").limit(4 * max_findings)
    bounded = (
        label_by_rule(featured(first))
        .select("label", *FEATURES, "_o", "value", "before")
        .orderBy("_o", "value", "before")
        .limit(max_findings)
    )
    made = featured(labelled_findings(docs.sparkSession))
    return fit(bounded.select("label", *FEATURES).unionByName(made.select("label", *FEATURES)), seed=seed, **options)


def _scored(text: Column, path: Column, model: SecretModel) -> Column:
    return F.transform(
        candidates(text, path),
        lambda x: F.struct(x["value"].alias("value"), x["lead"].alias("lead"), model.score(x).alias("score")),
    )


def scan(df: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: (doc_id, finding_no, value, score, is_secret); finding_no counts a text's candidates from 0.

    Null and empty texts have no candidate; repeated rows are scanned each. An undecided vote (exactly the threshold) is a secret.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), _scored(F.col(text_col).cast("string"), F.col(path_col).cast("string"), model).alias("f"))
    found = rows.select("doc_id", F.posexplode_outer("f").alias("finding_no", "x")).filter("finding_no is not null")
    return found.select("doc_id", "finding_no", "x.value", "x.score", (F.col("x.score") >= model.threshold).alias("is_secret"))


def redact(df: DataFrame, model: SecretModel, text_col: str = "text", path_col: str = "source", mark: str = "<SECRET>") -> DataFrame:
    """The same rows and columns with each secret in ``text_col`` replaced by ``mark``; other texts stay as they are."""
    text = F.col(text_col)
    columns, types = df.columns, dict(df.dtypes)
    hidden = max((c for c in columns), key=len, default="") + "_shown"
    shown = F.transform(_scored(text.cast("string"), F.col(path_col).cast("string"), model),
                        lambda x: F.struct((x["score"] >= model.threshold).alias("secret"), F.concat(x["lead"], F.when(x["score"] >= model.threshold, F.lit(mark)).otherwise(x["value"])).alias("text")))
    ends = F.concat(F.transform(F.col(f"`{hidden}`"), lambda x: x["text"]), F.array(F.lit("")))
    whole = F.array_join(F.flatten(F.zip_with(_between(text.cast("string")), ends, lambda g, v: F.array(g, v))), "")
    new = F.when(F.exists(F.col(f"`{hidden}`"), lambda x: x["secret"]), whole).otherwise(text)
    rows = df.withColumn(hidden, shown)
    return rows.select(*[(new.cast(types[c]).alias(c) if c == text_col else F.col(f"`{c}`")) for c in columns])
