"""Text kernels as SQL strings and columns; the SQL runs in Spark."""

from __future__ import annotations

from ..presets import ANCHOR_WORDS, GENERIC_LABEL_WORDS, LABEL_STOP_WORDS, MAPPER_STEM, QUERY_STEM, QUESTION_STARTS, RETRIEVAL_STEM

BARE_CODE = r"\\b[pPbBcCuU][0-9]{4}\\b"
KEYED_CODE = r"(?i)\\b(error|code|dtc|fault)\\s*[:#]?\\s*([a-z]?[0-9]{2,5})\\b"


def stem(word: str, rules: list[tuple[str, int, int]]) -> str:
    """SQL of a word's stem: words up to three letters stay, else the first rule that applies cuts its letters.

    A word ending in ``ss`` isn't cut by the rule for ``s`` where a rule for ``ss`` exists.
    """
    guarded = any(s == "ss" for s, _, _ in rules)
    cases = []
    for suffix, longer, cut in rules:
        extra = f" and not {word} like '%ss'" if suffix == "s" and guarded else ""
        cases.append(f"when {word} like '%{suffix}' and length({word}) > {longer}{extra} then left({word}, length({word}) - {cut})")
    return f"case when length({word}) <= 3 then {word} {' '.join(cases)} else {word} end"


def retrieval_stem(word: str) -> str:
    return stem(word, RETRIEVAL_STEM)


def query_stem(word: str) -> str:
    return stem(word, QUERY_STEM)


def mapper_stem(word: str) -> str:
    return stem(word, MAPPER_STEM)


def tokens(text: str) -> str:
    """SQL of the lower-cased words between white space."""
    return f"filter(split(lower({text}), '\\\\s+'), w -> w <> '')"


def alnum_tokens(text: str) -> str:
    """SQL of the runs of a-z and 0-9 of the lower-cased text."""
    return f"regexp_extract_all(lower({text}), '([a-z0-9]+)', 1)"


def stem_set(words: str, rules: list[tuple[str, int, int]], least: int = 3) -> str:
    """SQL of the sorted distinct stems of words with ``least`` letters or more."""
    return f"array_sort(array_distinct(transform(filter({words}, w -> length(w) >= {least}), w -> {stem('w', rules)})))"


def normalized_label(label: str) -> str:
    """SQL: lower case, slashes to blanks, punctuation out, single blanks."""
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({label})), '[/\\\\\\\\]', ' '), '(?U)[^\\\\w\\\\s]', ''), '\\\\s+', ' '))"


def _mapper_stems(words: list[str]) -> list[str]:
    """The stems of a fixed list, in Python."""
    out = set()
    for w in words:
        cut = next((c for s, longer, c in MAPPER_STEM if w.endswith(s) and len(w) > longer), 0) if len(w) > 3 else 0
        out.add(w[: len(w) - cut])
    return sorted(out)


def _list(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def label_stems(normalized: str) -> str:
    """SQL of a normalised label's distinctive stems: no stop words, single letters or generic stems."""
    words = f"filter(split({normalized}, ' '), w -> length(w) > 1 and not array_contains({_list(LABEL_STOP_WORDS)}, w))"
    return f"array_except(transform({words}, w -> {mapper_stem('w')}), {_list(_mapper_stems(GENERIC_LABEL_WORDS))})"


def label_match(norm_a: str, stems_a: str, norm_b: str, stems_b: str) -> str:
    """SQL of the domain-aware Jaccard of two labels: 1 if equal; 0 if both name subsystems but none in common."""
    anchors = _list(_mapper_stems(ANCHOR_WORDS))
    own = lambda s: f"array_intersect({s}, {anchors})"
    apart = f"size({own(stems_a)}) > 0 and size({own(stems_b)}) > 0 and not arrays_overlap({own(stems_a)}, {own(stems_b)})"
    return f"case when {norm_a} = {norm_b} then 1D when {apart} or size(array_union({stems_a}, {stems_b})) = 0 then 0D else size(array_intersect({stems_a}, {stems_b})) / size(array_union({stems_a}, {stems_b})) end"


def slug(text: str) -> str:
    return f"trim(both '_' from regexp_replace(lower({text}), '[^a-z0-9]+', '_'))"


def node_id(prefix: str, text: str) -> str:
    """SQL of prefix_slug_digest, with 40 letters of slug and 8 of MD5."""
    return f"concat_ws('_', '{prefix}', left({slug(text)}, 40), left(md5({text}), 8))"


def intent(text: str) -> str:
    """SQL: error_code, question or symptom_report."""
    low = f"lower(trim({text}))"
    starts = " or ".join(f"{low} like '{w}%'" for w in QUESTION_STARTS)
    return f"case when {text} rlike '{BARE_CODE}' or {text} rlike '{KEYED_CODE}' then 'error_code' when {low} like '%?' or {starts} then 'question' else 'symptom_report' end"


def error_codes(text: str) -> str:
    """SQL of the distinct upper-cased bare codes, then the first keyed one."""
    keyed = f"regexp_extract({text}, '{KEYED_CODE}', 2)"
    return f"array_distinct(concat(transform(regexp_extract_all({text}, '{BARE_CODE}', 0), c -> upper(c)), if({keyed} = '', array(), array(upper({keyed})))))"


def clean_category(category: str) -> str:
    return f"trim(split({category}, '[.]')[0])"


def title(text: str) -> str:
    """SQL: each run of letters starts with a capital, also after digits and punctuation."""
    return f"array_join(transform(regexp_extract_all(lower({text}), '([a-z]+|[^a-z]+)', 1), w -> concat(upper(left(w, 1)), substring(w, 2))), '')"
