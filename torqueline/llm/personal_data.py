"""Personal data spans by weak supervision, in DataFrame and SQL functions only.

Base spans come from one pattern a kind.  Spans are placed by splitting the text at the
matches: gap and match lengths add up to positions in code points (block by block, so
many matches in one text stay cheap).  Patterns are written so that no match recurses
and no start rescans a run, which keeps very long words and digit runs linear.

Further candidates (loosely written addresses and numbers, long mixed strings that may be
secrets, and what the base patterns match but their tests reject) are judged by six
labelers: shape, format test, gazetteer, context that speaks for, context that speaks
against, and alphabet (a random string, or one that looks like a digest, an id, a serial
number).  None of them has a length beyond which it doesn't look.  Their votes are counted over all documents by pattern of votes and of text
features that no labeler sees (what stands right before and after, and the length), of
which there is a fixed number; expectation-maximisation on that small table estimates
each labeler's reliability kind by kind, and a logistic span classifier is trained on its posteriors.
Candidates it accepts are added where they overlap no base span.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Those, and what only the classifier adds.
ALL_KINDS = (*KINDS, "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns: with possessive groups, and starts tied to the start of a run (or the end of the last match).
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before a pattern is tried.
NEEDS = {"email": "contains({t}, '@')", "ip": r"{t} rlike r'[0-9]\.[0-9]+\.[0-9]'", "card": r"{t} rlike r'[0-9](?:[ -]?[0-9]){{12}}'", "phone": r"contains({t}, '+')"}
_LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?: ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]{{2,}}+)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]{{2,}}+)++)",
    "secret": r"(?<![A-Za-z0-9_+/=.@-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+(?![@.])={0,2}",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,4}\) ?|(?:00[0-9]{1,3}[ .-])?[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
}
CANDIDATE = f"{BASE['email']}|{BASE['phone']}|{BASE['card']}|{BASE['ip']}|{_LOOSE['email']}|{_LOOSE['phone']}|{_LOOSE['secret']}".replace(r"(?:\G|(?<!", r"(?:(?<!")
_CANDIDATE_NEEDS = r"contains({t}, '@') or contains({t}, '[at]') or contains({t}, '(at)') or contains({t}, ' dot ') or {t} rlike r'[0-9]{{2}}\)? ?[ .-][0-9]{{3}}|[0-9](?:[ -]?[0-9]){{12}}|\+[0-9]|[0-9]\.[0-9]+\.[0-9]|[A-Za-z0-9_+/-]{{20}}'"
BLOCK, CONTEXT = 256, 24

#: Gazetteers and context words.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu|ch|at|be|pt|us|ca"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|35|6011|65"
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
SECRETS = "token|secret|api[_-]?key|access[_-]?key|key|passw(?:or)?d|pwd|auth|bearer|credentials?"
HASHES = "sha-?[0-9]*|md5|hash|commit|digest|checksum|integrity|uuid|https?|www"
FOR = "e-?mail|mail|contact|kontakt|tel|phone|fon|t[eé]l[eé]fono?|call|mobile?|fax|card|visa|carte|karte|tarjeta|ip|host|addr"
AGAINST = r"[=#$%][ \"]*$|[0-9][ ,.]*$|\b(?:version|isbn|page|seite|página|order|invoice|serial|id|no|nr)\b[^A-Za-z0-9]*$"
#: Votes with its class that a labeler is credited with beforehand, against one.
RIGHT = 4
#: Lengths of hexadecimal digests, and the bits a character of a random string has at least.
DIGESTS, BITS = (32, 40, 64, 128), 3.0


def spans_sql(text: str, pattern: str, needs: str) -> str:
    """SQL of array<struct<s, e, t, b, a>>: start, end, match, and the context before and after each match."""
    quoted = "r'" + pattern + "'"
    step = "named_struct('at', p.at + y.g + y.n, 'out', array_append(p.out, named_struct('s', p.at + y.g, 'e', p.at + y.g + y.n)))"
    none = "cast(array() as array<struct<s: int, e: int>>)"
    lens = "zip_with(slice(v.gaps, 1, size(v.m)), v.m, (g, t) -> named_struct('g', char_length(g), 'n', char_length(t)))"
    blocks = f"transform(array({lens}), all -> transform(sequence(0, (size(v.m) - 1) div {BLOCK}), k -> aggregate(slice(all, cast(k * {BLOCK} + 1 as int), {BLOCK}), named_struct('at', 0, 'out', {none}), (p, y) -> {step})))[0]"
    whole = f"flatten(aggregate({blocks}, named_struct('at', 0, 'out', cast(array() as array<array<struct<s: int, e: int>>>)), (q, l) -> named_struct('at', q.at + l.at, 'out', array_append(q.out, transform(l.out, z -> named_struct('s', z.s + q.at, 'e', z.e + q.at)))), q -> q.out))"
    full = f"transform({whole}, (z, i) -> named_struct('s', z.s, 'e', z.e, 't', v.m[i], 'b', right(v.gaps[i], {CONTEXT}), 'a', left(v.gaps[i + 1], {CONTEXT})))"
    empty = "cast(array() as array<struct<s: int, e: int, t: string, b: string, a: string>>)"
    found = f"transform(array(named_struct('gaps', split({text}, {quoted}, -1), 'm', regexp_extract_all({text}, {quoted}, 0))), v -> case when size(v.m) = 0 then {empty} else {full} end)[0]"
    return f"case when {needs.format(t=text)} then {found} else {empty} end"


def _digits(t: str) -> str:
    return f"regexp_replace({t}, '[^0-9]', '')"


def valid(kind: str, t: str) -> str:
    """SQL of the test a base match must pass."""
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"forall(split({t}, r'\\.'), p -> length(ltrim('0', p)) < 3 or length(ltrim('0', p)) = 3 and ltrim('0', p) <= '255')"
    n = f"length({_digits(t)})"
    if kind == "phone":
        return f"{n} between 9 and 15"
    value = "cast(substring(d, i, 1) as int)"
    twice = f"if((length(d) - i) % 2 = 1, if({value} > 4, {value} * 2 - 9, {value} * 2), {value})"
    luhn = f"transform(array({_digits(t)}), d -> aggregate(sequence(1, length(d)), 0, (k, i) -> k + {twice}) % 10 = 0)[0]"
    return f"{n} between 13 and 19 and {luhn}"


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with one column of base spans (array of s, e, t, b, a) for each kind; docs has a non-null text."""
    for kind in KINDS:
        docs = docs.withColumn(kind, F.expr(spans_sql("text", BASE[kind], NEEDS[kind])))
    return docs.withColumns({kind: F.expr(f"filter({kind}, x -> {valid(kind, 'x.t')})") for kind in KINDS})


def _kind(t: str) -> str:
    return f"case when {t} rlike r'@|[\\[(]at[\\])]| at ' then 'email' when {t} rlike r'^[0-9]+(\\.[0-9]+){{3}}$' then 'ip' when {t} rlike r'^[A-Za-z0-9_+/-]{{20,}}=*$' and {t} rlike '[A-Za-z]' then 'secret' when {t} like '+%' or length({_digits(t)}) < 13 then 'phone' else 'card' end"


#: Classes of a neighbouring character (none, blank, quote, other sign, letter or digit), and lengths at which the next class begins.
_NEIGHBOURS, _LENGTHS = 5, (12, 18, 32)


def _neighbour(c: str) -> str:
    return f"case when {c} = '' then 0 when {c} rlike r'\\s' then 1 when {c} in ('\"', '\\'', '`') then 2 when {c} rlike '[A-Za-z0-9]' then 4 else 3 end"


def _judged(x: str) -> str:
    """SQL of a candidate with kind, whether it is loosely written, the six votes (1 yes, 0 no, -1 none), and its text features."""
    d = _digits("c.t")
    strict = "(" + " or ".join(f"c.kind = '{k}' and c.t rlike r'^{BASE[k].replace(chr(92) + 'G|', '')}$' and {valid(k, 'c.t')}" for k in KINDS) + ")"
    loose = "(c.t rlike r'[\\[(]at[\\])]| at ' or c.kind = 'secret' or c.kind = 'phone' and not c.t like '+%')"
    mixed = f"length({d}) >= 4 and length(regexp_replace(c.t, '[^A-Za-z]', '')) >= 4"
    test = f"case c.kind when 'email' then if(c.t rlike r'(?:\\.|dot[\\])]? ?)[A-Za-z]{{2,24}}$', 1, 0) when 'secret' then if({mixed}, 1, 0) else if(case c.kind {' '.join(f'when {chr(39)}{k}{chr(39)} then {valid(k, chr(99) + chr(46) + chr(116))}' for k in KINDS[1:])} end, 1, 0) end"
    known = f"case c.kind when 'email' then if(c.t rlike r'(?i)(?:\\.|dot[\\])]? ?)(?:{DOMAINS})$', 1, -1) when 'phone' then if({d} rlike '^(?:00)?(?:{CALLING})' or {d} like '%555%', 1, -1) when 'ip' then if(c.t rlike '^(?:0|10|127|255|192.168)[.]', 0, -1) when 'secret' then if(c.b rlike r'(?i)(?:{SECRETS})[^A-Za-z0-9]*$', 1, 0) else if({d} rlike '^(?:{ISSUERS})', 1, 0) end"
    pro = f"case c.kind when 'secret' then if(c.b rlike r'[=:] ?[\"\\x27]?$', 1, -1) else if(c.b rlike r'(?i)\\b(?:{FOR})\\b(?:[^A-Za-z0-9]+[A-Za-z]+){{0,2}}[^A-Za-z0-9]*$', 1, -1) end"
    con = f"case c.kind when 'secret' then if(c.b rlike r'(?i)(?:{HASHES})[^A-Za-z0-9]*$', 0, -1) when 'email' then if(c.b rlike '[/@=&?]$' or c.a rlike '^[0-9A-Za-z_]', 0, -1) else if(c.b rlike r'(?i)(?:{AGAINST})' or c.a rlike '^[0-9A-Za-z_]', 0, -1) end"
    one = f"length(replace({d}, left({d}, 1), '')) = 0"
    bits = "aggregate(filter(array_distinct(split(c.t, '')), h -> h <> ''), 0d, (z, h) -> z - (1 - length(replace(c.t, h, '')) / length(c.t)) * log2(1 - length(replace(c.t, h, '')) / length(c.t)))"
    digest = f"c.t rlike '^(?:[0-9a-f]+|[0-9A-F]+)$' and length(c.t) in {DIGESTS} or c.t rlike '^[0-9A-Fa-f]{{8}}(?:-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}$' or c.t rlike '^[A-Za-z]+(?:[_/-][A-Za-z0-9]+)+$'"
    made = f"case c.kind when 'secret' then case when {digest} then 0 when {bits} >= {BITS}d then 1 else 0 end when 'card' then case when {one} then 0 when c.t rlike '^[0-9]{{4}}(?:([ -])[0-9]{{4}}\\\\1[0-9]{{4}}\\\\1[0-9]{{4}}$)' then 1 else -1 end when 'phone' then if({one}, 0, -1) else -1 end"
    long = " + ".join(f"if(length(c.t) > {n}, 1, 0)" for n in _LENGTHS)
    return (
        f"transform(transform({x}, y -> named_struct('s', y.s, 'e', y.e, 't', y.t, 'b', y.b, 'a', y.a, 'kind', {_kind('y.t')})), "
        f"c -> named_struct('s', c.s, 'e', c.e, 'kind', c.kind, 'loose', {loose}, 'v', array(if({strict}, 1, if({loose}, -1, 0)), {test}, {known}, {pro}, {con}, {made}), 'f', array({_neighbour('right(c.b, 1)')}, {_neighbour('left(c.a, 1)')}, {long})))"
    )


def candidates(docs: DataFrame) -> DataFrame:
    """docs with column ``judged``: candidates with their votes."""
    return docs.withColumn("cand", F.expr(spans_sql("text", CANDIDATE, _CANDIDATE_NEEDS))).withColumn("judged", F.expr(_judged("cand"))).drop("cand")


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over rows of votes with counts: prior, p(vote | class) of each labeler, posterior of each row.

    Rates are indexed by labeler, class and vote + 1.  They are those of a labeler that votes: one that abstains
    (-1) says nothing, its rate is 1.  Starts from the majority of votes; pseudo-counts (RIGHT votes with a class, one
    against it) hold labelers to be better than chance until there are enough votes.
    """
    if not len(votes):
        return 0.5, np.zeros((0, 2, 3)), np.zeros(0)
    post = (1 + (votes == 1).sum(1)) / (2 + (votes >= 0).sum(1))
    for _ in range(rounds):
        mass = np.stack([counts * (1 - post), counts * post])
        prior = (mass[1].sum() + 1) / (mass.sum() + 2)
        cast = [np.stack([mass @ (votes[:, j] == v) for v in (0, 1)], 1) + [[RIGHT, 1], [1, RIGHT]] for j in range(votes.shape[1])]
        rates = np.stack([np.c_[np.ones(2), c / c.sum(1, keepdims=True)] for c in cast])
        odds = np.log(prior / (1 - prior)) + sum(np.log(r[1, votes[:, j] + 1] / r[0, votes[:, j] + 1]) for j, r in enumerate(rates))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return float(prior), rates, post


def train_classifier(x: np.ndarray, y: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic weights (the last is the constant) for features, soft targets and counts, by damped gradient steps."""
    w = np.zeros(x.shape[1] + 1)
    x = np.c_[x, np.ones(len(x))]
    share = counts / max(counts.sum(), 1)
    for _ in range(rounds if len(x) else 0):
        off = share * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)
        w -= 4.0 * (x.T @ off + 1e-4 * np.r_[w[:-1], 0])
    return w


def _feature_tests() -> list[str]:
    """SQL conditions on a judged candidate c: the features of the classifier."""
    return [
        *[f"c.kind = '{k}' and c.v[{j}] = {v}" for k in ALL_KINDS for j in range(6) for v in (0, 1)], *[f"c.kind = '{k}'" for k in ALL_KINDS], "c.loose",
        *[f"c.f[{j}] = {n}" for j in (0, 1) for n in range(1, _NEIGHBOURS)], *[f"c.f[2] >= {n}" for n in range(1, len(_LENGTHS) + 1)],
    ]


def learn(docs: DataFrame) -> np.ndarray:
    """Weights of the span classifier, from every pattern of kind, form, votes and text features in docs.

    There are 5 * 2 * 3**6 * 5**2 * 4 such patterns at most, whatever the number of documents.
    """
    tests = F.expr("array(" + ", ".join(f"int({t})" for t in _feature_tests()) + ")")
    seen = candidates(docs).select(F.explode("judged").alias("c")).groupBy("c.kind", "c.loose", "c.v", "c.f").agg(F.count("*").alias("k"))
    seen = seen.select(F.struct("kind", "loose", "v", "f").alias("c"), "k").select(F.col("c.v").alias("v"), tests.alias("x"), "k", "c.kind").collect()
    seen.sort()  # so that sums have one order
    votes, x, counts = (np.array([r[i] for r in seen], float if i == 2 else np.int64) for i in range(3))
    if not len(seen):
        return np.r_[np.zeros(len(_feature_tests())), -1.0]
    post = np.zeros(len(seen))
    for kind in ALL_KINDS:  # a labeler is as reliable as it is on that kind
        own = np.array([r[3] == kind for r in seen])
        post[own] = reliabilities(votes[own], counts[own])[2]
    return train_classifier(x.astype(float), post, counts)


def score_sql(weights: np.ndarray) -> str:
    """SQL of the classifier's probability for a judged candidate c."""
    z = " + ".join([f"double({weights[-1]!r})", *[f"if({t}, double({w!r}), 0d)" for t, w in zip(_feature_tests(), weights[:-1], strict=True)]])
    return f"1d / (1d + exp(-({z})))".replace("np.float64", "")


def found_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with a column a kind of base spans, and ``spans``: all of them and those the classifier adds.

    spans is array<struct<o, s, e, kind>> in the order of ALL_KINDS, then start.
    """
    weights = learn(docs)
    rows = candidates(base_spans(docs))
    order = "array_position(array(" + ", ".join(f"'{k}'" for k in ALL_KINDS) + "), {})"
    base = "concat(" + ", ".join(f"transform({k}, x -> named_struct('o', {order.format(repr(k))}, 's', x.s, 'e', x.e, 'kind', '{k}'))" for k in KINDS) + ")"
    rows = rows.withColumn("base", F.expr(base))
    chosen = f"filter(judged, c -> c.v[0] <> 1 and {score_sql(weights)} >= {threshold}d and not exists(base, b -> b.s < c.e and c.s < b.e))"
    added = f"transform({chosen}, c -> named_struct('o', {order.format('c.kind')}, 's', c.s, 'e', c.e, 'kind', c.kind))"
    return rows.withColumn("spans", F.expr(f"array_sort(concat(base, {added}))")).drop("judged", "base")


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', cast(x.s as string), ':', cast(x.e as string))), ',')"


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, secret_spans of each row of docs (doc_id, text).

    Counts and base_sha256 are of base spans; spans lists all of the four kinds as
    kind:start:end, secret_spans likewise the secrets, which have no base pattern.  A null
    text is empty; rows are independent, so null or repeated ids pass through; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    done = found_spans(rows)
    listed = "concat(" + ", ".join(f"transform({k}, x -> named_struct('kind', '{k}', 's', x.s, 'e', x.e))" for k in KINDS) + ")"
    return done.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.expr(_listed(listed)), 256).alias("base_sha256"), F.expr(_listed("filter(spans, x -> x.kind <> 'secret')")).alias("spans"), F.expr(_listed("filter(spans, x -> x.kind = 'secret')")).alias("secret_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by <KIND>, n_chars (if docs has it) counted anew; null texts stay null.

    Overlapping spans are replaced as one, by the kind that starts first.
    """
    have = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in have]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    done = found_spans(rows)
    by_start = "array_sort(transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"
    joined = f"aggregate({by_start}, named_struct('to', 0, 'out', cast(array() as array<string>)), (a, x) -> named_struct('to', greatest(a.to, x.e), 'out', if(x.s < a.to, a.out, concat(a.out, array(substring(text, a.to + 1, x.s - a.to), concat('<', upper(x.kind), '>'))))), a -> concat(array_join(a.out, ''), substring(text, a.to + 1)))"
    done = done.withColumn("_text", F.when(F.col("_row")["text"].isNull(), F.lit(None).cast("string")).when(F.size("spans") == 0, F.col("text")).otherwise(F.expr(joined)))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in have])
