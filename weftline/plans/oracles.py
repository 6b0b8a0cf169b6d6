"""SQL pieces for DuckDB that say the same as the text functions and the routing plan."""

UP, LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
WHITE = r"'[ \t\n\v\f\r]+'"
TOKEN = r"'[!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~ \t\n\v\f\r]+'"
URL = r"'https?://[A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=%]*'"


def lower(x: str) -> str:
    return f"translate({x}, {UP}, {LOW})"


def sanitize(x: str) -> str:
    return f"trim(regexp_replace({lower(x)}, {WHITE}, ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {WHITE}), lambda u: u <> '')"


def urls(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({x}, {URL}), lambda u: regexp_replace(u, '[.,);]+$', '')), lambda u: strlen(u) > 10)"


def cosine(a: str, b: str) -> str:
    """In single precision; its sums go from left to right."""
    dot = lambda x, y: f"list_reduce(list_transform(range(1, len({x}) + 1), lambda i: {x}[i] * {y}[i]), lambda s, t: s + t)"
    norm = lambda v: f"sqrt({dot(v, v)})::FLOAT"
    return f"({dot(a, b)} / ({norm(a)} * {norm(b)}))"


def kept(ws: str, stop: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in stop)
    return f"list_filter({ws}, lambda u: u NOT IN ({listed}))"


def phrases(source: str, key: str, stop: list[str]) -> str:
    """CTEs phrase_words and tried(key, ord, phrase) over a table `source` with the key and a column full."""
    return f"""
phrase_words AS (SELECT {key}, "full", ws, {kept("ws", stop)} AS kw FROM (SELECT {key}, "full", {words('"full"')} AS ws FROM {source})),
grams AS (SELECT {key}, gk, gi, array_to_string(list_slice(ws, gi, gi + gk - 1), ' ') AS phrase
  FROM phrase_words, range(1, 6) AS sizes(gk), LATERAL (SELECT unnest(range(1, len(ws) - gk + 2)) AS gi) WHERE len(ws) > 2 AND gk <= least(5, len(ws) - 1)),
listed AS (SELECT {key}, 0 AS a, 0 AS b, 0 AS c, "full" AS phrase FROM phrase_words
  UNION ALL SELECT {key}, 1, 0, 0, array_to_string(kw, ' ') FROM phrase_words WHERE len(kw) > 0 AND len(kw) < len(ws)
  UNION ALL SELECT {key}, 2, -gk, gi, phrase FROM grams),
tried AS (SELECT * FROM (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY a, b, c) - 1 AS ord, phrase FROM listed) WHERE ord < 15)"""


def routed(source: str, key: str, stop: list[str], threshold: float, early: float, size: int) -> str:
    """CTEs up to routes(key, intent_name, score, ord) for the texts of `source`, with all benchmark items as registry."""
    bucket = f"('0x' || substr(md5(w), 1, 8))::BIGINT % {size}"
    return (
        phrases(source, key, stop)
        + f""",
examples AS (SELECT item_id AS reg_ord, 'INTENT_' || (item_id % 8) AS name, {sanitize("text")} AS phrase FROM benchmark),
vectors AS (SELECT phrase, b, count(*) AS n FROM (SELECT phrase, {bucket} AS b FROM
  (SELECT phrase, unnest({words("phrase")}) AS w FROM (SELECT phrase FROM tried UNION SELECT phrase FROM examples))) GROUP BY phrase, b),
norms AS (SELECT phrase, sqrt(sum(n * n)::FLOAT)::FLOAT AS norm FROM vectors GROUP BY phrase),
dots AS (SELECT p.phrase, e.reg_ord, e.name, sum(p.n * x.n)::FLOAT AS dot, e.phrase AS example
  FROM vectors p JOIN vectors x ON p.b = x.b JOIN examples e ON e.phrase = x.phrase
  WHERE p.phrase IN (SELECT phrase FROM tried) GROUP BY p.phrase, e.reg_ord, e.name, e.phrase),
scores AS (SELECT d.phrase, reg_ord, name, dot / (a.norm * b.norm) AS s FROM dots d JOIN norms a ON a.phrase = d.phrase JOIN norms b ON b.phrase = d.example),
best AS (SELECT * FROM (SELECT phrase, name, s, row_number() OVER (PARTITION BY phrase ORDER BY s DESC, reg_ord) AS r FROM scores) WHERE r = 1),
reached AS (SELECT t.{key}, t.ord, b.name, b.s FROM tried t JOIN best b ON b.phrase = t.phrase),
gate AS (SELECT {key} FROM reached WHERE ord = 0 AND s >= {early}::FLOAT),
routes AS (SELECT {key}, arg_min(name, ord) AS intent_name, arg_min(s, ord) AS score, min(ord) AS ord
  FROM reached WHERE s >= {threshold}::FLOAT AND {key} IN (SELECT {key} FROM gate) GROUP BY {key})"""
    )
