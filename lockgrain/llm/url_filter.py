"""URL filter by character language models of accepted and rejected addresses.

Two variable-order Markov models over characters, smoothed by interpolating each order with the next lower one, are
fitted to all addresses that are known to be accepted or rejected.  An address is rejected if the difference of its
log-likelihoods a character exceeds a threshold that is calibrated on accepted addresses kept out of the fit.
Listed rules come first: the longest one that fits decides.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockgrain.llm.common import discard, if_small, prepare, staged, without

ORDER = 5
#: Log-likelihoods of a character are summed as whole multiples of 1 / UNIT.
UNIT = 1 << 32
#: Share of the accepted addresses kept out of the fit that the threshold may reject.
FALSE_REJECTS = 0.01
#: Rules of the query: verdict by host and path prefix.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, at a tie the alphabetically first; null if none does."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


class Markov:
    """Counts of characters after every context of up to ``order`` characters; Witten-Bell interpolation.

    For a few texts, in memory; ``differences`` has the same of two models as a table.
    """

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order, count = order, Counter()
        for t in texts:
            t = "\x02" * order + t + "\x03"
            for k in range(order + 1):
                count.update([t[i - k : i + 1] for i in range(order, len(t))])
        #: How often a gram (a context and the character after it) occurs; how often a context, and with how many characters.
        self.count, self.total, self.kinds = dict(count), defaultdict(int), defaultdict(int)
        for gram, n in count.items():
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1
        self.total, self.kinds = dict(self.total), dict(self.kinds)

    def chance(self, context: str, char: str) -> float:
        p = 1 / 0x110000  # any character can follow
        for k in range(self.order + 1):
            c = context[self.order - k :]
            n = self.total.get(c)
            if n is None:
                break
            kinds = self.kinds[c]
            p = (self.count.get(c + char, 0) + kinds * p) / (n + kinds)
        return p


class Ratio:
    """Length-normalised log-likelihood difference, rejected minus accepted; above ``edge`` an address is rejected.

    For a few addresses, in memory; ``scores`` does it for any number, and parts the accepted addresses by a hash.
    """

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER, false_rejects: float = FALSE_REJECTS):
        # every fifth accepted address, in an order that does not depend on the partitioning, calibrates
        accepted = sorted(accepted)
        held, used = accepted[::5], [x for i, x in enumerate(accepted) if i % 5]
        self.order, self.memo = order, {}
        self.no, self.yes = Markov(rejected, order), Markov(used, order)
        self.known = bool(used) and bool(rejected)
        scores = sorted(map(self.score, held)) if self.known else []
        self.memo = {}
        self.edge = max(0.0, scores[min(len(scores) - 1, math.ceil(len(scores) * (1 - false_rejects)))] if scores else 0.0)

    def score(self, text: str) -> float:
        t = "\x02" * self.order + text + "\x03"
        total, memo = 0.0, self.memo
        for i in range(self.order, len(t)):
            gram = t[i - self.order : i + 1]
            d = memo.get(gram)
            if d is None:
                if len(memo) > 500_000:
                    memo.clear()
                d = memo[gram] = math.log(self.no.chance(gram[:-1], gram[-1])) - math.log(self.yes.chance(gram[:-1], gram[-1]))
            total += d
        return total / (len(t) - self.order)

    def rejects(self, text: str) -> bool:
        return self.known and self.score(text) > self.edge


def windows(address: Column, order: int = ORDER) -> Column:
    """Every character of an address, and its end, with the ``order`` characters before it."""
    chars = F.split(F.concat(F.lit("\x02" * order), address, F.lit("\x03")), "")
    part = lambda c: F.transform(F.sequence(F.lit(order + 1), F.size(c)), lambda i: F.array_join(F.slice(c, i - order, F.lit(order + 1)), ""))
    return F.get(F.transform(F.array(chars), part), F.lit(0))  # the characters are split once


def differences(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(window, diff): log-likelihood of a window's last character after the others, rejected minus accepted, in units of 1 / ``UNIT``.

    ``counts`` (window, no, yes) has how often each stands in rejected and in accepted addresses; a shorter gram is the
    end of longer ones.  As in ``Markov``, each order is interpolated with the next lower one.
    """
    before = None
    for k in range(order + 1):
        grams = counts.groupBy(F.substring("window", order + 1 - k, k + 1).alias("gram")).agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
        context = Window.partitionBy(F.substring("gram", 1, k))
        for m in ("no", "yes"):
            grams = grams.withColumns({f"n_{m}": F.sum(m).over(context), f"kinds_{m}": F.sum((F.col(m) > 0).cast("long")).over(context)})
        if before is None:
            grams = grams.withColumns({"p_no": F.lit(1 / 0x110000), "p_yes": F.lit(1 / 0x110000)})  # any character can follow
        else:
            grams = grams.join(before, F.substring(grams.gram, 2, k) == before.shorter).drop("shorter")
        p = {m: F.when(F.col(f"n_{m}") > 0, (F.col(m) + F.col(f"kinds_{m}") * F.col(f"p_{m}")) / (F.col(f"n_{m}") + F.col(f"kinds_{m}"))).otherwise(F.col(f"p_{m}")) for m in ("no", "yes")}
        before = grams.select(F.col("gram").alias("shorter"), p["no"].alias("p_no"), p["yes"].alias("p_yes"))
    return before.select(F.col("shorter").alias("window"), F.round((F.log("p_no") - F.log("p_yes")) * UNIT).cast("long").alias("diff"))


def held_out(address: Column) -> Column:
    """Whether an accepted address calibrates, about one in five; it is then in no count, however often it stands."""
    return F.pmod(F.xxhash64(address, F.lit(5)), F.lit(5)) == 0


def scores(pages: DataFrame, order: int = ORDER, false_rejects: float = FALSE_REJECTS) -> tuple[DataFrame, float] | None:
    """((_a, _b, score) of each address without a verdict, by its two hashes; the threshold) from (id, address, said).

    Both models are counted over all addresses with a verdict, each distinct (id, address) once.  None if there are not
    both kinds.  Sums are made in whole units, so that no order of rows changes a result.
    """
    known = pages.distinct().groupBy("address", "said").agg(F.count("*").alias("n"))
    kind = F.when(F.col("said") == "block", "no").when(F.col("said") == "allow", F.when(held_out(F.col("address")), "held").otherwise("yes")).otherwise("open")
    known = staged(known.select("address", kind.alias("kind"), "n"), "addresses")
    rows = {r.kind: r.n for r in known.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    if "no" not in rows or not {"yes", "held"} & rows.keys():
        discard(known)
        return None
    # too few to calibrate with
    fit = known if "yes" in rows else known.withColumn("kind", F.when(F.col("kind") == "held", "yes").otherwise(F.col("kind")))
    held = rows.get("held", 0) if "yes" in rows else 0
    counted = fit.select(F.explode(windows(F.col("address"), order)).alias("window"), *[F.when(F.col("kind") == m, F.col("n")).otherwise(0).alias(m) for m in ("no", "yes")])
    counts = staged(counted.groupBy("window").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")), "windows")
    diffs = staged(differences(counts, order), "differences")
    judged = fit.where(F.col("kind").isin("open", "held")).select(*hashes(F.col("address")), "kind", "n", (F.length("address") + 1).alias("size"), F.explode(windows(F.col("address"), order)).alias("window"))
    summed = judged.join(if_small(diffs), "window").groupBy("_a", "_b", "kind", "n", "size").agg(F.sum("diff").alias("diff"))
    scored = staged(summed.select("_a", "_b", "kind", "n", (F.col("diff") / UNIT / F.col("size")).alias("score")), "scores")
    discard(known, counts, diffs)
    edge = 0.0
    if held:  # the least of the highest scores that may be rejected, and of the next one
        most = held - min(held - 1, math.ceil(held * (1 - false_rejects)))
        top = scored.where("kind = 'held'").select("score", "n").orderBy(F.desc("score")).limit(most)
        top = top.withColumn("m", F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)))
        edge = max(edge, top.where(F.col("m") >= most).agg(F.max("score")).first()[0])
    return scored.where("kind = 'open'").select("_a", "_b", "score"), edge


def hashes(address: Column) -> tuple[Column, Column]:
    return F.xxhash64(address).alias("_a"), F.xxhash64(F.lit(1), address).alias("_b")


def judge(pages: DataFrame, rules: dict[str, str] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Append host, path, rule, score (null where a rule decides) and verdict to every row.

    The models are fitted to all addresses on which the rules decide, as tables: no process holds a whole model, unless
    it is small.  If either kind is missing, undecided addresses are allowed, with a null score.  Null urls have empty
    host and path and go to the models as the empty address.  Whole addresses count, however long.  Repeated rows get
    equal results, an empty table gives an empty one, and input columns with an output's name are replaced.
    """
    prepare(pages.sparkSession)
    pages = without(pages, "host", "path", "rule", "verdict", "score", "_listed", "_a", "_b")
    found = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    found = found.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    listed = F.lit(None).cast("string")
    for rule, said in rules.items():
        listed = F.when(F.col("rule") == rule, said).otherwise(listed)
    found = found.withColumn("_listed", listed)
    address = F.concat("host", "path")
    fitted = scores(found.select(F.col(id_col).alias("id"), address.alias("address"), F.col("_listed").alias("said")))
    if fitted is None:
        scored, edge = found.withColumn("score", F.lit(None).cast("double")), 0.0
    else:
        scored, edge = fitted
        a, b = hashes(address)
        scored = found.withColumns({"_a": a, "_b": b}).join(if_small(scored), ["_a", "_b"], "left").drop("_a", "_b")
    return scored.withColumn("verdict", F.coalesce("_listed", F.when(F.col("score") > edge, "block").otherwise("allow"))).drop("_listed")
