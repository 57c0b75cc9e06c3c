"""SQL text shared by the statements of several families."""

W = r"[\p{L}\p{N}_]+"
NW = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{W}')"


def space_words(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '\s+'), lambda t: t <> '')"


def padded(x: str) -> str:
    return f"(' ' || array_to_string({words(x)}, ' ') || ' ')"


def has_phrase(pad: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({pad}, {q(' ' + p + ' ')})" for p in phrases) + ")"


def contains_any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([。！？.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def tokens(x: str) -> str:
    return f"CAST(greatest(1, length({x}) // 3) AS BIGINT)"


def search_tokens(x: str) -> str:
    cjk = "^[぀-ヿ一-鿿]"
    return (
        rf"flatten(list_transform(regexp_extract_all(lower({x}), '[\p{{Latin}}\p{{N}}_]{{2,}}|[぀-ヿ一-鿿]+'), lambda r: "
        f"CASE WHEN regexp_matches(r, '{cjk}') AND length(r) > 1 THEN list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) ELSE [r] END))"
    )


def entities(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '(?:^|{NW})(\p{{Lu}}\p{{Ll}}{{2,}}(?: +\p{{Lu}}\p{{Ll}}+)*)', 1))"


def overlap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def whole_days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


def frac_days(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"


def fmt(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def stem(x: str, irregular: dict | None = None) -> str:
    def cut(k):
        return f"substring({x}, 1, length({x}) - {k})"

    body = f"""CASE WHEN length({x}) > 6 AND ends_with({x}, 'ations') THEN {cut(6)} WHEN length({x}) > 5 AND ends_with({x}, 'ation') THEN {cut(5)}
      WHEN length({x}) > 5 AND ends_with({x}, 'ies') THEN {cut(3)} || 'y'
      WHEN length({x}) > 5 AND ends_with({x}, 'ing') THEN CASE WHEN ends_with({cut(3)}, 'k') THEN {cut(3)} || 'e' ELSE {cut(3)} END
      WHEN length({x}) > 4 AND ends_with({x}, 'ied') THEN {cut(3)} || 'y' WHEN length({x}) > 4 AND (ends_with({x}, 'ed') OR ends_with({x}, 'es')) THEN {cut(2)}
      WHEN length({x}) > 3 AND ends_with({x}, 's') THEN {cut(1)} ELSE {x} END"""
    if not irregular:
        return f"({body})"
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in irregular.items())
    return f"(CASE {x} {cases} ELSE {body} END)"
