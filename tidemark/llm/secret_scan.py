"""Secrets in texts: patterns propose candidates, a random forest removes false positives.

A candidate is a run of at least SHORTEST characters of the key alphabet with a digit, or with sixteen capitals in a row;
or what is assigned with = or : to a word that ends in a secret word: a quoted string without spaces, or any other run, of
ASSIGNED characters or more. A run that the forest turns down is looked at once more by the parts that are candidates themselves.
The forest looks at its length, its character transitions, how much of it a dictionary covers, whether it is part of a
path, and the words before it. Dictionary and transitions are learned from the corpus: the words that stand in most of its
texts, and the pairs of letters that make up half of those words; words of identifiers and placeholders are added. It is trained on the driver from a bounded number of labelled findings, by default made by
rule; features of findings and of candidates come from the same expressions. Its trees become CASE expressions, so texts are
scanned and judged by built-in functions alone, in place.

Null and empty texts have no candidates, an empty table gives an empty one, repeated rows are judged each, and of equal
candidates all or none are secrets. report() returns its own columns only. redacted() returns all columns of docs, whatever
their names, and changes none but the text. candidates() and scan() add columns under the names that they are given, in
place of any that are there.
"""

from __future__ import annotations

import random
import string
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import spans as P
from tidemark.llm.common import fresh

SHORTEST, ASSIGNED = 12, 6
KEY_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|[A-Z]{16})[A-Za-z0-9+/_-]{" + str(SHORTEST) + ",}+"
#: Characters before and after a candidate that are looked at; findings that the forest learns from, at most.
CONTEXT, FINDINGS = 40, 4000
TREES, DEPTH, LEAF, KEEP = 15, 6, 5, 0.5
#: Words that are learned, by the number of texts that hold them; letters of a word; share of the pairs of letters in them that count as natural.
WORDS, LETTERS, NATURAL = 400, (4, 12), 0.5
#: Words that names, identifiers and placeholders are made of; words that stand before secrets, and before other keys.
DICTIONARY = "account admin alpha backup beta build chapter client cloud config count data date default demo dev document dummy east example file final form group house image index invoice item local main model name north number order page part paper photo place prod project record release report sample section server south staging summary table team test text title update user value version week west word year".split()
SECRET_WORDS = "apikey api_key auth authorization bearer credential key passwd password pwd secret token".split()
PLAIN_WORDS = "branch card checksum commit digest doi hash id isbn md5 order page ref revision sha sha1 sha256 ticket tracking uuid version".split()
#: A secret word, looked back at in words of one length at a time; what may stand between it and the value; the value.
_NAMED = "(?:" + "|".join(f"(?<=(?i:{'|'.join(w for w in SECRET_WORDS if len(w) == n)}))" for n in sorted({len(w) for w in SECRET_WORDS})) + ")"
_SIGN = r"[\"'\]]{0,2}+[\x20\t]{0,2}+(?>=>|[=:]{1,2})[\x20\t]{0,2}+"
_SPACE = r"\x20\x09-\x0D"
_VALUE = rf"(?:\"[^\"{_SPACE}]{{{ASSIGNED},}}+|'[^'{_SPACE}]{{{ASSIGNED},}}+|[^\"'{_SPACE}][^{_SPACE}]{{{ASSIGNED - 1},}}+)"
#: A key run, or the sign and the value of an assignment; _LEAD is what stands before the value in a match.
CANDIDATE = rf"{KEY_RUN}|(?=[\"'\]\x20\t=:]){_NAMED}{_SIGN}{_VALUE}"
_LEAD = rf"^{_SIGN}[\"']?"


@dataclass(frozen=True)
class Vocabulary:
    """What candidates are held against: words, and pairs of letters that words are full of."""

    words: tuple[str, ...]
    pairs: tuple[str, ...]


def vocabulary(counts: Sequence[tuple[str, int]]) -> Vocabulary:
    """From words and how often they count; the fixed words are added."""
    weight: Counter[str] = Counter()
    for w, n in [*counts, *((w, 1) for w in DICTIONARY)]:
        for i in range(len(w) - 1):
            weight[w[i : i + 2]] += n
    pairs: list[str] = []
    left = NATURAL * sum(weight.values())
    for p, n in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
        if left <= 0:
            break
        pairs.append(p)
        left -= n
    return Vocabulary(tuple(sorted({w for w, _ in counts} | set(DICTIONARY), key=lambda w: (-len(w), w))), tuple(pairs))


def learn(docs: DataFrame, text: str = "text") -> Vocabulary:
    """The vocabulary of a corpus: texts are counted for each word where they lie, and WORDS words come to the driver."""
    low, high = LETTERS
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"(?<![\p{{L}}\p{{N}}_])[a-z]{{{low},{high}}}+(?![\p{{L}}\p{{N}}_])"), F.lit(0))
    n = docs.select(F.explode(F.array_distinct(found)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary([tuple(r) for r in n.orderBy(F.desc("n"), "word").limit(WORDS).collect()])


#: The vocabulary where there is no corpus.
FIXED = vocabulary([])


def features(before: Column, cand: Column, after: Column, vocab: Vocabulary = FIXED) -> dict[str, Column]:
    n = F.length(cand).cast("double")
    share = lambda p: F.regexp_count(cand, F.lit(p)) / n
    low = F.lower(cand)
    classes = F.translate(cand, string.ascii_lowercase + string.ascii_uppercase + string.digits, "a" * 26 + "A" * 26 + "0" * 10)
    word = F.regexp_extract(F.lower(before), r"([a-z0-9_]+)[^a-z0-9_]{0,4}$", 1)
    return {
        "length": n,
        "changes": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / n,
        "natural_pairs": F.regexp_count(low, F.lit(f"(?=(?:{'|'.join(vocab.pairs)}))")) / n,
        "distinct": F.size(F.array_distinct(F.split(cand, ""))) / n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "symbols": share("[+/_-]"),
        "punctuation": share("[^A-Za-z0-9+/_-]"),
        "placeholder": cand.rlike(r"^[<$%{*]|\(|^(.)\1+$").cast("double"),
        "hex": cand.rlike("^[0-9a-f]+$").cast("double"),
        "dictionary": 1 - F.length(F.regexp_replace(low, "|".join(vocab.words), "")) / n,
        "known_form": cand.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abp]-|^sk-[A-Za-z0-9]{20}").cast("double"),
        "grouped": cand.rlike("^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$").cast("double"),
        "path": (before.rlike(r"[/\\.]$") | cand.rlike("/.*/") | after.rlike(r"^\.[a-z]{2,4}\b")).cast("double"),
        "assigned": before.rlike("[=:]\\s{0,2}[\"']?$").cast("double"),
        "secret_word": word.rlike(f"(?:^|_)(?:{'|'.join(SECRET_WORDS)})$").cast("double"),
        "plain_word": word.isin(*PLAIN_WORDS).cast("double"),
    }


def labelled_findings(n: int = 3000, seed: int = 13) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, label): invented findings, half of them secrets, as a review of scanner hits would give."""
    rnd = random.Random(seed)
    up, low, alnum, hexa = string.ascii_uppercase + string.digits, string.ascii_lowercase, string.ascii_letters + string.digits, "0123456789abcdef"
    of = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    syllable = lambda: rnd.choice("ba che der ein for ger hat ion ket lan men nor ouv per que rin sto tion und ver wil".split())
    prose = lambda: " ".join("".join(syllable() for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(1, 6)))
    sep = lambda: rnd.choice(["=", " = ", ": ", ' = "', '="', ":"])
    name = lambda: rnd.choice(SECRET_WORDS)
    yes = [
        lambda: (prose() + " ", "AKIA" + of(up, 16), " " + prose()),
        lambda: (prose() + " " + name() + sep(), "AKIA" + of(up, 16), '" '),
        lambda: (prose() + " " + name() + sep(), of(hexa, rnd.choice([16, 18, 20, 24, 32, 40, 64])), rnd.choice([" ", '" ', "\n"]) + prose()),
        lambda: (prose() + " " + name() + sep(), of(alnum, rnd.randrange(14, 44)), rnd.choice([" ", '" ']) + prose()),
        lambda: (prose() + " ", "ghp_" + of(alnum, 36), " " + prose()),
        lambda: (prose() + " " + name() + sep(), of(alnum + "+/", rnd.randrange(24, 60)), "== "),
        lambda: ("bearer ", of(alnum + "-_", rnd.randrange(24, 60)), " " + prose()),
    ]
    ident = lambda: "-".join([rnd.choice(DICTIONARY) for _ in range(rnd.randrange(2, 4))] + [str(rnd.randrange(2100))])
    group = lambda: "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12))
    no = [
        lambda: (prose() + " " + rnd.choice(PLAIN_WORDS) + rnd.choice([" ", ": ", "="]), of(hexa, rnd.choice([32, 40, 64])), " " + prose()),
        lambda: (prose() + " ", group(), " " + prose()),
        lambda: (prose() + " ", of(string.digits, rnd.randrange(12, 20)), " " + prose()),
        lambda: (prose() + " " + rnd.choice(["", "id ", "see "]), ident(), " " + prose()),
        lambda: (prose() + " https://" + syllable() + ".example/", syllable() + "/" + ident() + "/" + str(rnd.randrange(10**6)), ".html "),
        lambda: (prose() + " ", "".join(syllable() for _ in range(8)).upper()[: rnd.randrange(16, 24)], "!! " + prose()),
        lambda: (prose() + " ", "".join(syllable() for _ in range(rnd.randrange(4, 8))) + of(string.digits, rnd.randrange(1, 3)), " " + prose()),
        lambda: (prose() + " " + name() + sep(), rnd.choice(["x" * rnd.randrange(11, 20) + "1", "your-" + rnd.choice(["token", "key", "password"]) + "-here-123", "example-" + ident(), "0" * rnd.randrange(12, 20), "123456789012"]), " "),
        lambda: (prose() + " ", of(low, 3) + "-" + "-".join(of(string.digits, 4) for _ in range(rnd.randrange(2, 4))), " " + prose()),
    ]
    found = [(*rnd.choice(yes if i % 2 else no)(), i % 2) for i in range(n)]
    # values that only the word before them gives away, and what else follows such words
    word = lambda: "".join(syllable() for _ in range(rnd.randrange(2, 4)))[:10]
    marks = lambda t, k: "".join(c + (rnd.choice("!@#$%&.*?") if i in k else "") for i, c in enumerate(t))
    whole = [
        lambda: (word() + of(string.digits, rnd.randrange(1, 5)))[-11:].rjust(6, "q"),
        lambda: "".join(rnd.choice([c, c.upper(), {"a": "4", "e": "3", "i": "1", "o": "0"}.get(c, c)]) for c in word().ljust(6, "k")) + of(string.digits, rnd.randrange(1, 4)),
        lambda: "".join(syllable() for _ in range(rnd.randrange(5, 9))),
        lambda: of(string.ascii_letters, rnd.randrange(10, 44)),
        lambda: marks(of(alnum, rnd.randrange(7, 24)), {rnd.randrange(1, 6), rnd.randrange(1, 6)}),
        lambda: of(alnum, rnd.randrange(7, 14)),
    ]
    other = [
        lambda: word().ljust(6, "e") + rnd.choice(["", ".", ",", ";"]),
        lambda: rnd.choice(DICTIONARY) + rnd.choice(["_", "-", "."]) + rnd.choice(DICTIONARY),
        lambda: rnd.choice(["<" + word() + "-" + name() + ">", "${" + word().upper() + "}", "{{" + word() + "}}", "*" * rnd.randrange(6, 14), "x" * rnd.randrange(6, 14), "$" + word(), "%" + word() + "%"]),
        lambda: rnd.choice(["get", "read", "load"]) + rnd.choice(["Token", "Key", "Secret", "Password"]) + "()" + rnd.choice(["", ";"]),
        lambda: rnd.choice(["required", "optional", "string", "enabled", "disabled", "missing", "changed", "expired", "invalid", "undefined"]),
    ]
    put = lambda value: (prose() + " " + rnd.choice(["", "", "db_", "user_", "my_"]) + name() + sep(), value, rnd.choice([" ", '" ', "\n"]) + prose())
    return found + [(*put(rnd.choice(whole if i % 2 else other)()), i % 2) for i in range(n // 3)]


class Forest:
    """Trees of yes/no questions on features, each grown on a resample with a random choice of features at each node."""

    def __init__(self, x: np.ndarray, y: np.ndarray, vocab: Vocabulary = FIXED, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 17):
        self.rng, self.vocab = np.random.default_rng(seed), vocab
        self.trees = [self._grow(x[r], y[r], depth, leaf) for r in (self.rng.integers(0, len(x), len(x)) for _ in range(trees))]

    def _grow(self, x, y, depth, leaf):
        if depth == 0 or len(y) < 2 * leaf or y.min() == y.max():
            return float(y.mean())
        best = None
        for f in self.rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
            cuts = cuts[(cuts >= leaf) & (cuts <= len(y) - leaf)]
            if not len(cuts):
                continue
            left = np.cumsum(t)[cuts - 1]
            p, q = left / cuts, (t.sum() - left) / (len(t) - cuts)
            impurity = cuts * p * (1 - p) + (len(t) - cuts) * q * (1 - q)
            i = impurity.argmin()
            if best is None or impurity[i] < best[0]:
                best = (impurity[i], f, (v[cuts[i] - 1] + v[cuts[i]]) / 2)
        if best is None:
            return float(y.mean())
        go = x[:, best[1]] <= best[2]
        return int(best[1]), float(best[2]), self._grow(x[go], y[go], depth - 1, leaf), self._grow(x[~go], y[~go], depth - 1, leaf)

    def score(self, x: Sequence[Column]) -> Column:
        def column(node) -> Column:
            return F.lit(node) if isinstance(node, float) else F.when(x[node[0]] <= node[1], column(node[2])).otherwise(column(node[3]))

        total = column(self.trees[0])
        for t in self.trees[1:]:
            total = total + column(t)
        return total / len(self.trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        def one(node, row):
            while not isinstance(node, float):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return np.array([sum(one(t, r) for t in self.trees) / len(self.trees) for r in x])


def train(spark: SparkSession, findings: Sequence[tuple[str, str, str, int]] | None = None, vocab: Vocabulary = FIXED) -> Forest:
    """A forest from (before, candidate, after, label); of more than FINDINGS of them, as many are drawn by a fixed seed."""
    findings = labelled_findings() if findings is None else list(findings)
    if len(findings) > FINDINGS:
        findings = random.Random(FINDINGS).sample(findings, FINDINGS)
    table = spark.createDataFrame([tuple(f) for f in findings], "before string, cand string, after string, label int")
    got = table.select("label", *(c.alias(k) for k, c in features(F.col("before"), F.col("cand"), F.col("after"), vocab).items())).collect()
    return Forest(np.array([r[1:] for r in got], float), np.array([r[0] for r in got], float), vocab)


def candidates(docs: DataFrame, text: str = "text", out: str = "_cands") -> DataFrame:
    """Adds out: (start, end, match, before, after, parts) of each candidate of a text; parts are the candidates in it."""
    t = F.coalesce(F.col(text), F.lit(""))

    def around(s: Column, offset: Column) -> tuple[Column, ...]:
        value = F.regexp_replace(s["match"], _LEAD, "")
        end = s["end"] + offset
        start = end - F.length(value)
        before = F.substring(t, F.greatest(F.lit(1), start - CONTEXT + 1), F.least(F.lit(CONTEXT), start))
        return start.alias("start"), end.alias("end"), value.alias("match"), before.alias("before"), F.substring(t, end + 1, F.lit(CONTEXT)).alias("after")

    def parted(s: Column) -> Column:
        inner = F.transform(P.find(s["match"], CANDIDATE, s["match"].rlike("[^A-Za-z0-9+/_-]")), lambda i: F.struct(*around(i, s["start"])))
        return F.struct(*(s[k].alias(k) for k in ("start", "end", "match", "before", "after")), inner.alias("parts"))

    found = P.find(t, CANDIDATE, t.rlike("[A-Za-z0-9+/_-]{12}|[=:]"))
    return docs.withColumn(out, F.transform(F.transform(found, lambda s: F.struct(*around(s, F.lit(0)))), parted))


def scan(docs: DataFrame, forest: Forest | None = None, keep: float = KEEP, text: str = "text", cands: str = "_cands", out: str = "_secrets") -> DataFrame:
    """Adds cands, and out, the candidates whose score is at least keep, or else those of their parts."""
    forest = forest or train(docs.sparkSession, vocab=learn(docs, text))

    def judge(s: Column) -> Column:
        named = F.struct(*(c.cast("double").alias(k) for k, c in features(s["before"], s["match"], s["after"], forest.vocab).items()))
        # features once, then the trees on their values
        return F.element_at(F.transform(F.array(named), lambda v: forest.score([v[k] for k in features(F.lit(""), F.lit(""), F.lit(""))])), 1) >= keep

    def passed(c: Column) -> Column:
        whole = F.struct(*(c[k].alias(k) for k in ("start", "end", "match", "before", "after")))
        good = F.filter(F.concat(F.array(whole), c["parts"]), judge)
        return F.element_at(F.transform(F.array(good), lambda g: F.when(F.exists(g, lambda s: (s["start"] == c["start"]) & (s["end"] == c["end"])), F.slice(g, 1, 1)).otherwise(g)), 1)

    return candidates(docs, text, cands).withColumn(out, F.flatten(F.transform(cands, passed)))


def report(docs: DataFrame, forest: Forest | None = None, keep: float = KEEP, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans of each row."""
    found = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), forest, keep, "text")
    marked = F.transform("_secrets", lambda s: F.struct(F.lit("secret").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", F.size("_cands").cast("long").alias("n_candidates"), F.size("_secrets").cast("long").alias("n_secrets"), P.joined(marked).alias("spans"))


def redacted(docs: DataFrame, forest: Forest | None = None, keep: float = KEEP, text: str = "text", label: str = "[SECRET]") -> DataFrame:
    """docs with each secret replaced by label; rows without one are unchanged."""
    cands, secrets = fresh(docs.columns, "_cands", "_secrets")
    found = scan(docs, forest, keep, text, cands, secrets)
    return found.withColumn(text, F.when(F.size(secrets) > 0, P.replaced(F.col(text), F.col(secrets), lambda s: F.lit(label))).otherwise(F.col(text))).select(*docs.columns)
