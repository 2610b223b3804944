"""The property graph: one table of vertices, one table of edges."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from sparkgas.plans.skew import ROWS_PER_PIECE, EdgeStats

DIRECTIONS = ("none", "in", "out", "both")


class PropertyGraph:
    """A directed multigraph.

    ``vertices`` has a unique ``id`` and any data columns; ``edges`` has
    ``src``, ``dst`` and any data columns, and may hold parallel edges and
    self-loops.  Edges with an end missing from ``vertices`` take part in
    nothing; with ``validate=True`` they are an error.  ``complete=True`` states
    that there are none, which saves the joins that would look for them.
    ``rows_per_piece`` is the number of edges above which the edges of one
    vertex are spread over several tasks.
    """

    def __init__(
        self,
        vertices: DataFrame,
        edges: DataFrame,
        validate: bool = False,
        complete: bool = False,
        rows_per_piece: int = ROWS_PER_PIECE,
    ):
        if "id" not in vertices.columns:
            raise ValueError("vertices need a column 'id'")
        if not {"src", "dst"} <= set(edges.columns):
            raise ValueError("edges need columns 'src' and 'dst'")
        self.vertices = vertices
        self.edges = edges
        self.complete = complete or validate
        self.rows_per_piece = rows_per_piece
        self._stats: EdgeStats | None = None
        if validate:
            self.validate()

    @classmethod
    def from_rows(
        cls,
        spark: SparkSession,
        vertices: Iterable[tuple],
        edges: Iterable[tuple],
        vertex_schema: str = "id bigint, data bigint",
        edge_schema: str = "src bigint, dst bigint, data bigint",
    ) -> PropertyGraph:
        """A graph from collections held by the caller."""
        return cls(
            spark.createDataFrame(list(vertices), vertex_schema),
            spark.createDataFrame(list(edges), edge_schema),
        )

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    @property
    def vertex_columns(self) -> list[str]:
        return [c for c in self.vertices.columns if c != "id"]

    @property
    def edge_columns(self) -> list[str]:
        return [c for c in self.edges.columns if c not in ("src", "dst")]

    def validate(self) -> None:
        """Raise if ids repeat or an edge has an end outside the vertices."""
        if not self.vertices.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("vertex ids are not unique")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        if not ends.join(self.vertices.select("id"), "id", "left_anti").isEmpty():
            raise ValueError("an edge has an end that is not a vertex")

    def with_vertices(self, vertices: DataFrame) -> PropertyGraph:
        """The same ids with other data."""
        graph = self._like(vertices, self.edges)
        graph._stats = self._stats
        return graph

    def with_edges(self, edges: DataFrame) -> PropertyGraph:
        """Other edges among the same vertices."""
        return self._like(self.vertices, edges)

    def _like(self, vertices: DataFrame, edges: DataFrame) -> PropertyGraph:
        return PropertyGraph(vertices, edges, complete=self.complete, rows_per_piece=self.rows_per_piece)

    def stats(self) -> EdgeStats:
        """Count and hot ids of the edges between vertices; counted once per edge table."""
        if self._stats is None:
            self._stats = EdgeStats(self.inner_edges(), self.rows_per_piece)
        return self._stats

    def inner_edges(self) -> DataFrame:
        """The edges with both ends among the vertices: those that take part in anything.

        Adaptive planning splits the rows of a hot end.
        """
        if self.complete:
            return self.edges
        edges, ids = self.edges, self.vertices.select("id")
        for end in ("src", "dst"):
            edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
        return edges.select(*[f"`{c}`" for c in self.edges.columns])

    def cache(self) -> PropertyGraph:
        level = StorageLevel.MEMORY_AND_DISK
        return self._like(self.vertices.persist(level), self.edges.persist(level))

    def unpersist(self) -> None:
        self.vertices.unpersist()
        self.edges.unpersist()

    def counts(self) -> DataFrame:
        """Two rows ``(kind, n)``: number of edges and number of vertices."""
        return self.edges.agg(F.lit("edges").alias("kind"), F.count("*").alias("n")).unionByName(
            self.vertices.agg(F.lit("vertices").alias("kind"), F.count("*").alias("n"))
        )

    def n_vertices(self) -> int:
        return self.vertices.count()

    def n_edges(self) -> int:
        return self.edges.count()

    def preview(self, n: int = 10) -> DataFrame:
        """The first ``n`` vertices by id."""
        return self.vertices.orderBy("id").limit(n)

    def fetch_all(self) -> tuple[list[Row], list[Row]]:
        """All vertices and edges as rows on the driver; for small graphs only."""
        return self.vertices.collect(), self.edges.collect()
