"""Entity graph: merge, adjacency, neighbourhoods, matching, communities, context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..providers import LLMProvider
from .names import Coded


def rule_entities(docs: DataFrame, low: int = 5, share: float = 0.002, least: int = 4, key: str = "doc_id", text: str = "text", floor: int = 12) -> DataFrame:
    """name, doc_id, ord (first place in the document) of tokens of `least` characters or more that few documents have.

    Few: from `low` distinct texts (copies count once) to `share` of all distinct texts, `floor` at least.
    """
    coded = Coded(docs, low, share, least, key, text, floor)
    return coded.named(coded.mentions(), "name")


def rule_relations(coded: Coded) -> DataFrame:
    """source, target (source < target), doc_id, ord of pairs of entities in one sentence."""
    return coded.named(coded.pairs, "source", "target")


_GRAPH = "struct<entities:array<struct<name:string,type:string>>,relationships:array<struct<source:string,target:string,relation:string>>>"


def extract(docs: DataFrame, llm: LLMProvider, most_entities: int = 10, most_relations: int = 15, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Entities (name, entity_type, doc_id, ord) and relations (source, target, relation, weight, doc_id, ord) that a model finds in each text.

    One call a text; names are in lower case; of a reply the first most_entities and most_relations count, and the prompt asks for no
    more; a failed call or a reply without JSON gives none.
    """
    reply = llm.generate_json(F.concat(F.lit("graph\n---\n"), F.col(text), F.lit(f"\n---\nat most {most_entities} entities and {most_relations} relationships")), _GRAPH, 1)
    found = _cut(docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), reply.alias("g")))  # a filter here would read the reply twice
    e = found.select("doc_id", F.posexplode(F.slice("g.entities", 1, most_entities)).alias("ord", "e")).filter("e.name IS NOT NULL")
    r = found.select("doc_id", F.posexplode(F.slice("g.relationships", 1, most_relations)).alias("ord", "r")).filter("r.source IS NOT NULL AND r.target IS NOT NULL")
    entities = e.select(F.lower("e.name").alias("name"), F.coalesce("e.type", F.lit("")).alias("entity_type"), "doc_id", "ord")
    relations = r.select(F.lower("r.source").alias("source"), F.lower("r.target").alias("target"), F.coalesce("r.relation", F.lit("")).alias("relation"), F.lit(1.0).alias("weight"), "doc_id", "ord")
    return entities, relations


def merge_entities(entities: DataFrame) -> DataFrame:
    """name, entity_type (that of the first mention), documents (in order) and how many, from rows name, entity_type, doc_id, ord."""
    mention = F.struct("doc_id", "ord")
    return entities.groupBy("name").agg(F.min_by("entity_type", mention).alias("entity_type"), F.array_sort(F.collect_list("doc_id")).alias("document_ids"), F.count(F.lit(1)).alias("mentions"))


def merge_relations(relations: DataFrame) -> DataFrame:
    """source, target, weight (greatest), relation (first by document), documents; (a, b) and (b, a) stay apart."""
    mention = F.struct("doc_id", "ord")
    return relations.groupBy("source", "target").agg(F.max("weight").alias("weight"), F.min_by("relation", mention).alias("relation"), F.array_sort(F.collect_set("doc_id")).alias("document_ids"))


def merge_descriptions(rows: DataFrame, key: str = "name", llm: LLMProvider | None = None) -> DataFrame:
    """Distinct descriptions in order: one as it is, several merged by a model; joined by spaces where there is none or it fails."""
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "ord", "description")))
    per = rows.filter("description <> ''").groupBy(key).agg(F.array_distinct(F.transform(ordered, lambda s: s["description"])).alias("_d"))
    joined = F.array_join("_d", " ")
    if llm is not None:
        joined = F.coalesce(llm.generate(F.when(F.size("_d") > 1, F.concat(F.lit("summary\n---\n"), F.array_join("_d", "\n\n...\n\n"), F.lit("\n---\n")))), joined)
    return per.select(key, joined.alias("description"))


def adjacency(relations: DataFrame) -> DataFrame:
    """node, neighbour: both directions, once each."""
    forth = relations.select(F.col("source").alias("node"), F.col("target").alias("neighbour"))
    return forth.unionByName(relations.select(F.col("target").alias("node"), F.col("source").alias("neighbour"))).distinct()


def neighbourhood(seeds: DataFrame, edges: DataFrame, levels: int) -> DataFrame:
    """query_id, node, level (0 for seeds) of nodes within `levels` levels, seeds counting as the first; 0 levels: none. What a level adds is computed once, if another level follows."""
    if levels <= 0:
        return seeds.select("query_id", "node", F.lit(0).alias("level")).limit(0)
    seen = frontier = _stored(seeds.select("query_id", "node", F.lit(0).alias("level")).distinct(), "level")
    for level in range(1, levels):
        step = frontier.join(edges, "node").select("query_id", F.col("neighbour").alias("node")).distinct()
        frontier = step.join(seen, ["query_id", "node"], "left_anti").withColumn("level", F.lit(level))
        if level + 1 < levels:
            frontier = _stored(frontier, "level")
        seen = seen.unionByName(frontier)
    return seen


def query_entities(queries: DataFrame, llm: LLMProvider, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """query_id, entity: what a model names in each query (a JSON array), in lower case; query_words where it fails or names none."""
    named = llm.generate_json(F.concat(F.lit("entities\n---\n"), F.col(text), F.lit("\n---\n")), "array<string>", 1)
    asked = _cut(queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("text"), F.filter(F.transform(named, lambda x: F.lower(F.trim(x))), lambda x: x != "").alias("e")))
    found = asked.filter("size(e) > 0").select("query_id", F.explode(F.array_distinct("e")).alias("entity"))
    return found.unionByName(query_words(asked.filter("e IS NULL OR size(e) = 0")))


def query_words(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """Entities of a query when no model extracts them: its words of more than three characters, in lower case."""
    found = F.filter(T.words(F.col(text)), lambda w: F.length(w) > 3)
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(F.transform(found, F.lower))).alias("entity"))


def fuzzy_match(asked: DataFrame, names: DataFrame, gram: int = 4) -> DataFrame:
    """query_id, node: entities whose name contains, or is contained in, a query's entity.

    Candidates come from equal `gram`-grams: a contained string's rarest gram is one of the containing one's, so the shorter side
    sends one gram and the longer all of its own; contained strings shorter than a gram are looked up among all
    substrings of their length. Each distinct query entity is compared once, however many queries ask for it.
    """
    one, all_ = asked.select(F.col("entity").alias("s")).distinct(), names.select(F.col("name").alias("s")).distinct()

    def grams(n: Column | int, s: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - n + 1)), lambda i: F.substring(s, i, F.lit(n) if isinstance(n, int) else n)))

    def inside(small: DataFrame, large: DataFrame) -> DataFrame:
        """small, large: strings of the one frame that strings of the other contain."""
        spread = large.select(F.col("s").alias("large"), F.explode(grams(gram, F.col("s"))).alias("g"))
        counts = spread.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        long = small.filter(F.length("s") >= gram).select(F.col("s").alias("small"), F.explode(grams(gram, F.col("s"))).alias("g"))
        # a gram that no large string has leaves its string without a match; of the others the rarest is asked for
        rare = long.join(counts, "g", "left").groupBy("small").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
        hits = rare.join(spread, "g").select("small", "large")
        short = small.filter(F.length("s") < gram).select(F.col("s").alias("small"))
        if gram > 1:
            parts = large.select(F.col("s").alias("large"), F.explode(F.array_distinct(F.flatten(F.array(*(grams(k, F.col("s")) for k in range(1, gram)))))).alias("small"))
            hits = hits.unionByName(short.filter("small <> ''").join(parts, "small").select("small", "large"))
        return hits.filter(F.contains("large", "small")).distinct()

    hit = inside(one, all_).select(F.col("small").alias("entity"), F.col("large").alias("node"))
    hit = hit.unionByName(inside(all_, one).select(F.col("large").alias("entity"), F.col("small").alias("node"))).distinct()
    return asked.join(hit, "entity").select("query_id", "node").distinct()


def graph_boost(dense: DataFrame, graph_ids: DataFrame, k: int, factor: float = 1.2) -> DataFrame:
    """Dense results (query_id, id, score), those in graph_ids times the factor, ranked again."""
    from .vector import top_k

    marked = dense.join(graph_ids.select("query_id", "id").distinct().withColumn("_in", F.lit(True)), ["query_id", "id"], "left")
    return top_k(marked.select("query_id", "id", F.round(F.col("score") * F.when(F.col("_in"), factor).otherwise(1.0), 9).alias("score")), k)


def local_context(near: DataFrame, entities: DataFrame, relations: DataFrame, most: int = 20, named: Callable[..., DataFrame] = lambda df, *_: df) -> DataFrame:
    """query_id, content: the entities (by name, `most`) and relations (by source and target, `most`) of each neighbourhood.

    named: gives names for codes in the columns that it is told, where nodes are codes, which are in the order of names. What is
    beyond `most` at one end of a relation is left out before both ends are brought together.
    """
    w = Window.partitionBy("query_id")

    def first(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("rn", F.row_number().over(w.orderBy(*by))).filter(F.col("rn") <= most)

    head = first(near.select("query_id", "node").join(entities.select(F.col("name").alias("node")).distinct(), "node", "left_semi"), "node")
    shown = named(head.join(entities.select(F.col("name").alias("node"), "entity_type"), "node").select("query_id", "rn", "node", "entity_type"), "node")
    lines = shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat(F.lit("- "), F.col("node"), F.lit(" ("), F.col("entity_type"), F.lit(")")).alias("l")))), lambda s: s["l"]), "\n").alias("e"))
    ends = [first(relations.join(near.select("query_id", F.col("node").alias(end)), end).select("query_id", "source", "target", "relation", "weight"), "source", "target").drop("rn") for end in ("source", "target")]
    touching = named(first(ends[0].unionByName(ends[1]).distinct(), "source", "target"), "source", "target")
    strength = F.when(F.col("weight") != 1.0, F.concat(F.lit(" (strength: "), F.col("weight").cast("long").cast("string"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), F.col("source"), F.lit(" → ["), F.col("relation"), F.lit("] → "), F.col("target"), strength)
    rels = touching.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("l")))), lambda s: s["l"]), "\n").alias("r"))
    return lines.join(rels, "query_id", "left").select("query_id", F.concat(F.lit("## Relevant Entities\n"), F.col("e"), F.when(F.col("r").isNotNull(), F.concat(F.lit("\n\n## Relationships\n"), F.col("r"))).otherwise("")).alias("content"))


def components(edges: DataFrame) -> DataFrame:
    """node, community (its least node) by alternating stars; bounded by the logarithm of the diameter. Least neighbours are aggregates that are joined, so that a hub isn't one task."""
    e = _cut(edges.select(F.greatest("node", "neighbour").alias("a"), F.least("node", "neighbour").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        m = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        e = _cut(m.select("a", F.col("m").alias("b")).unionByName(m.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("community")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("community")).distinct())
        before = now


def propagate_labels(edges: DataFrame, rounds: int | None = 5) -> DataFrame:
    """node, community by synchronous label propagation over weighted edges (node, neighbour, weight); ties go to the least label.

    rounds: None goes on until labels are those of an earlier round. Where they alternate in a
    cycle, the labels of the cycle's first round to be met stand.
    """
    labels = _cut(edges.select("node").distinct().withColumn("community", F.col("node")))
    seen: set[tuple] = set()
    while rounds is None or rounds > 0:
        rounds = rounds if rounds is None else rounds - 1
        votes = edges.join(labels.select(F.col("node").alias("neighbour"), "community"), "neighbour").groupBy("node", "community").agg(F.sum("weight").alias("w"))
        own = labels.select("node", "community", F.lit(0.5).alias("w"))
        every = votes.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w"))
        labels = _cut(every.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("s")).select("node", "s.community"))
        if rounds is None:
            now = tuple(labels.agg(F.expr("bit_xor(xxhash64(node, community))"), F.expr("sum(cast(xxhash64(community, node) AS decimal(20, 0)))")).first())
            if now in seen:
                break
            seen.add(now)
    return labels


def modularity(edges: DataFrame, parts: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of a partition (node, community) of weighted edges, each in both directions (node, neighbour, weight); 0 without edges."""
    total = edges.agg(F.sum("weight")).first()[0]
    if not total:
        return 0.0
    a, b = parts.select("node", F.col("community").alias("_a")), parts.select(F.col("node").alias("neighbour"), F.col("community").alias("_b"))
    joined = edges.join(a, "node").join(b, "neighbour")
    inside = joined.filter("_a = _b").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    squares = joined.groupBy("_a").agg((F.sum("weight") / total).alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    return inside / total - resolution * squares


def modular(edges: DataFrame, resolution: float = 1.0, rounds: int = 10) -> DataFrame:
    """node, community by modularity: nodes move to the neighbouring community of greatest gain, then communities become nodes, until none moves.

    edges: node, neighbour, weight in both directions. In a round a half of the nodes, by hash, may move, so that neighbours don't
    swap places for ever; a level ends when neither half moves, or after `rounds`. A level that doesn't raise modularity is dropped.
    """
    level = _cut(edges.filter("node <> neighbour").groupBy("node", "neighbour").agg(F.sum("weight").alias("weight")))
    nodes = _cut(edges.select("node").distinct())
    members = nodes.select("node", F.col("node").alias("community"))
    total = level.agg(F.sum("weight")).first()[0]
    if not total:
        return members
    own = level.select("node", F.col("node").alias("neighbour")).distinct().withColumn("weight", F.lit(0.0))  # loops: what is inside a node
    while True:
        every = _cut(level.unionByName(own))
        degree = _cut(every.groupBy("node").agg(F.sum("weight").alias("k")))
        parts = _cut(degree.select("node", F.col("node").alias("community"), F.lit(False).alias("moved")))
        before, still, r = modularity(every, parts, resolution), 0, 0
        while still < 2 and r < rounds:
            placed = degree.join(parts.select("node", "community"), "node")
            sums = placed.groupBy("community").agg(F.sum("k").alias("s"))
            to = level.join(parts.select(F.col("node").alias("neighbour"), "community"), "neighbour").groupBy("node", "community").agg(F.sum("weight").alias("w"))
            stay = placed.select("node", "community", F.lit(0.0).alias("w"))
            options = to.unionByName(stay).groupBy("node", "community").agg(F.sum("w").alias("w")).join(sums, "community").join(placed.select("node", "k", F.col("community").alias("now")), "node")
            rest = F.col("s") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("w") - resolution * F.col("k") * rest / total, 9)
            choice = options.groupBy("node", "now").agg(F.min(F.struct((-gain).alias("g"), (F.col("community") != F.col("now")).alias("m"), "community")).alias("c"))
            turn = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
            parts = _cut(choice.select("node", F.when(turn, F.col("c.community")).otherwise(F.col("now")).alias("community"), (turn & (F.col("c.community") != F.col("now"))).alias("moved")))
            still, r = 0 if parts.filter("moved").limit(1).count() else still + 1, r + 1
        best = parts.select("node", "community")
        if modularity(every, best, resolution) <= before + 1e-9:
            return members
        members = _cut(members.join(best.select(F.col("node").alias("community"), F.col("community").alias("_up")), "community").select("node", F.col("_up").alias("community")))
        a, b = best.select("node", F.col("community").alias("_a")), best.select(F.col("node").alias("neighbour"), F.col("community").alias("_b"))
        merged = _cut(every.join(a, "node").join(b, "neighbour").groupBy(F.col("_a").alias("node"), F.col("_b").alias("neighbour")).agg(F.sum("weight").alias("weight")))
        level, own = merged.filter("node <> neighbour"), merged.filter("node = neighbour")
        if level.isEmpty():
            return members


def communities(edges: DataFrame, levels: int = 1) -> DataFrame:
    """level, node, community: a partition by modularity at each of the levels' resolutions."""
    every = None
    for k, resolution in enumerate(modularity_levels(levels)):
        part = modular(edges, resolution).select(F.lit(k).alias("level"), "node", "community")
        every = part if every is None else every.unionByName(part)
    return every


def modularity_levels(levels: int = 1) -> list[float]:
    """Resolutions of independent partitions: 1.0 alone, else 0.5 .. 1.5 in equal steps."""
    return [1.0] if levels == 1 else [0.5 + i / (levels - 1) for i in range(levels)]


def score_communities(queries: DataFrame, communities: DataFrame) -> DataFrame:
    """query_id, community, score: cosine times 1 + rank / 20; communities without an embedding take no part."""
    sim = F.coalesce(V.cosine(F.col("q"), F.col("embedding")), F.lit(0.0))
    known = communities.filter("embedding IS NOT NULL AND size(embedding) > 0")
    return queries.select("query_id", F.col("embedding").alias("q")).crossJoin(known).select("query_id", "community", F.round(sim * (1.0 + F.col("rank") / 20.0), 6).alias("score"))


def internal_edges(membership: DataFrame, relations: DataFrame) -> DataFrame:
    """community, source, target, weight of relations with both ends in the community."""
    a = membership.select(F.col("node").alias("source"), "community")
    b = membership.select(F.col("node").alias("target"), "community")
    return relations.join(a, "source").join(b, ["target", "community"])


def report_parts(membership: DataFrame, relations: DataFrame, size: int = 8000) -> DataFrame:
    """community, part, report: all entities of each community, then all its internal relations, in parts of about `size` characters.

    Each is a sentence of its own, which a model that quotes can pick: as lists they were one sentence, and the answer was the whole part.
    """
    link = F.concat("source", F.lit(" - "), "target")
    lines = membership.select("community", F.lit(0).alias("kind"), F.col("node").alias("line")).unionByName(internal_edges(membership, relations).select("community", F.lit(1).alias("kind"), link.alias("line")))
    before = F.sum(F.length("line") + 2).over(Window.partitionBy("community").orderBy("kind", "line").rowsBetween(Window.unboundedPreceding, -1))
    placed = lines.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / size).cast("int"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("line"))))
    per = placed.groupBy("community", "part").agg(of(0).alias("n"), of(1).alias("l"))
    named, linked = (F.when(F.size(c) > 0, F.array_join(c, ". ")) for c in ("n", "l"))
    return per.select("community", "part", F.concat_ws(". ", named, linked).alias("report"))


def whole_reports(parts: DataFrame) -> DataFrame:
    """community, report: the parts in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "report"))), lambda s: s["report"])
    return parts.groupBy("community").agg(F.array_join(ordered, ". ").alias("report"))


def _cut(df: DataFrame) -> DataFrame:
    from ..lineage import cut

    return cut(df)


def _stored(df: DataFrame, name: str) -> DataFrame:
    from ..lineage import stored

    return stored(df, name)
