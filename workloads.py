"""Generated graphs for the benchmark: films (directors, actors, performances, genres, countries) and a store of plain
triples, with the queries that are timed over them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import terms as R

FB = "http://freebase.com/"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
XSD = "http://www.w3.org/2001/XMLSchema#"
KINDS = 20  # genres, and countries


def _dice(n: int | Column, *salt) -> Column:
    """A whole number from 0 below n, the same in every run."""
    return F.pmod(F.xxhash64(*salt), F.lit(n) if isinstance(n, int) else n)


def _iri(kind: str, i: Column) -> Column:
    return R.make(1, F.concat(F.lit(f"{FB}{kind}/"), i.cast("string")))


def _english(text: Column) -> Column:
    return R.make(2, text, R.LANG_STRING, F.lit("en"))


def films(spark: SparkSession, triples: int) -> DataFrame:
    """Quads of a film graph: triples / 15 films, / 50 directors, / 12 actors, 2 to 5 performances a film."""
    n_films, n_directors, n_actors = max(20, triples // 15), max(10, triples // 50), max(30, triples // 12)
    out = []

    def add(df: DataFrame, s: Column, p: str, o: Column) -> None:
        out.append(df.select(F.lit("").alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o")))

    for kind, n, name in (("genre", KINDS, "Genre"), ("country", KINDS, "Country"), ("director", n_directors, "Director"), ("actor", n_actors, "Actor"), ("film", n_films, "Film")):
        every = spark.range(n)
        add(every, _iri(kind, F.col("id")), R.TYPE, R.make(1, F.lit(f"{FB}film.{kind}")))
        add(every, _iri(kind, F.col("id")), LABEL, _english(F.concat(F.lit(f"{name} "), F.col("id").cast("string"))))
    film, i = spark.range(n_films), F.col("id")
    at = lambda k: F.lit(k)
    add(film, _iri("film", i), f"{FB}film.film.directed_by", _iri("director", _dice(n_directors, i, at(1))))
    date = F.format_string("%04d-%02d-%02d", 1950 + _dice(75, i, at(2)), 1 + _dice(12, i, at(3)), 1 + _dice(28, i, at(4)))
    add(film, _iri("film", i), f"{FB}film.film.initial_release_date", R.make(2, date, f"{XSD}date"))
    add(film, _iri("film", i), f"{FB}film.film.rating", R.make(2, F.format_string("%.1f", 1 + _dice(90, i, at(5)) / 10), f"{XSD}float"))
    several = lambda n, low, salt: film.withColumn("j", F.explode(F.sequence(F.lit(1), low + _dice(n, i, at(salt)))))
    add(several(3, 1, 6).select("id", _dice(KINDS, i, F.col("j"), at(7)).alias("k")).distinct(), _iri("film", i), f"{FB}film.film.genre", _iri("genre", F.col("k")))
    add(several(2, 1, 8), _iri("film", i), f"{FB}film.film.country", _iri("country", F.pmod(i + F.col("j"), F.lit(KINDS))))
    cast = several(4, 2, 9).withColumn("perf", i * 8 + F.col("j"))
    perf = _iri("performance", F.col("perf"))
    add(cast, _iri("film", i), f"{FB}film.film.starring", perf)
    add(cast, perf, R.TYPE, R.make(1, F.lit(f"{FB}film.performance")))
    add(cast, perf, f"{FB}film.performance.actor", _iri("actor", _dice(n_actors, F.col("perf"), at(10))))
    add(cast, perf, f"{FB}film.performance.film", _iri("film", i))
    add(cast, perf, f"{FB}film.performance.character", _english(F.concat(F.lit("Character "), F.col("j").cast("string"))))
    quads = out[0]
    for df in out[1:]:
        quads = quads.union(df)
    return quads


PREFIXES = f"PREFIX f: <{FB}> PREFIX ff: <{FB}film.film.> PREFIX fp: <{FB}film.performance.> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\n"
FILM_QUERIES = {
    "by_director": "SELECT ?film ?title { ?film ff:directed_by <http://freebase.com/director/0> ; rdfs:label ?title }",
    "per_genre": "SELECT ?genre (COUNT(?film) AS ?count) { ?film ff:genre ?genre } GROUP BY ?genre ORDER BY DESC(?count)",
    "actors_in_film": "SELECT ?actor ?name { <http://freebase.com/film/0> ff:starring ?p . ?p fp:actor ?actor . ?actor rdfs:label ?name }",
    "top_ten": "SELECT ?film ?title ?rating { ?film a f:film.film ; rdfs:label ?title ; ff:rating ?rating } ORDER BY DESC(?rating) LIMIT 10",
    "actors_by_director": "SELECT DISTINCT ?actor ?name { ?film ff:directed_by <http://freebase.com/director/0> ; ff:starring ?p . ?p fp:actor ?actor . ?actor rdfs:label ?name }",
    "optional_rating": "SELECT ?film ?title ?rating { ?film a f:film.film ; rdfs:label ?title OPTIONAL { ?film ff:rating ?rating } }",
    "regex": 'SELECT ?s ?label { ?s rdfs:label ?label FILTER(REGEX(?label, "^Film [1-9]")) }',
    "ask": "ASK { ?film ff:directed_by <http://freebase.com/director/0> }",
    "construct": "CONSTRUCT { ?film <urn:v:by> ?name } WHERE { ?film ff:directed_by ?d . ?d rdfs:label ?name }",
}


def plain_triples(spark: SparkSession, n: int = 3_000_000, predicates: int = 200) -> DataFrame:
    """Triples s<i> p<i mod predicates> "value_<i>"."""
    i = F.col("id").cast("string")
    return spark.range(n).select(
        F.lit("").alias("g"), R.make(1, F.concat(F.lit("http://example.org/s"), i)).alias("s"), F.concat(F.lit("http://example.org/p"), F.pmod("id", F.lit(predicates)).cast("string")).alias("p"),
        R.make(2, F.concat(F.lit("value_"), i), R.STRING).alias("o"),
    )
