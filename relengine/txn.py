"""Changes of tables: the rows of a table as statements leave them, and transactions.

A state is a table's stored rows with the steps that statements add, and the rows that were inserted.
UPDATE and DELETE compose columns, so nothing is copied before it must be and reads of a
transaction see its own writes. Each statement counts its rows by segment; what is published are
these segments, read again with the steps applied: no row is looked up or moved.

COMMIT is optimistic. If another session changed a table meanwhile, the rows that the transaction
touched must be as they were at its start, compared by hash; then its changes are applied to the
newer rows. All tables of a transaction are published as one version of the catalog.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relengine.plans.ast import SqlError
from relengine.storage import RID, SEGMENT, Database, Segment, Storage, Table

TOUCHED, GONE = "_touched", "_gone"


@dataclass
class State:
    """A table's rows in a transaction, and the table as it was when it was first touched."""

    storage: Storage
    db: Database
    base: Table
    next_rid: int
    steps: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    inserted: DataFrame | None = None
    #: Stored rows that are gone, inserted rows that are left, and the last parts of the names of segments with touched rows.
    n_gone: int = 0
    n_inserted: int = 0
    hit: set[str] = field(default_factory=set)

    @staticmethod
    def of(storage: Storage, db: Database, table: Table) -> State:
        return State(storage, db, table, table.next_rid)

    def old(self, only: list[Segment] | None = None) -> DataFrame:
        """The stored rows, or those of some segments, as the steps leave them; deleted ones are marked."""
        rows = self.storage.read(self.db, self.base, only, segment=True).withColumns({TOUCHED: F.lit(False), GONE: F.lit(False)})
        for step in self.steps:
            rows = step(rows)
        return rows

    def _all(self) -> DataFrame:
        rows = self.old()
        return (rows if self.inserted is None else rows.unionByName(self.inserted)).filter(f"not {GONE}")

    @property
    def live(self) -> DataFrame:
        return self._all().drop(TOUCHED, GONE, SEGMENT)

    def count(self, hit: Column, test: Column) -> tuple[dict[str | None, int], bool]:
        """How many rows of each segment (None: inserted ones) are hit, and whether the test holds for one of them."""
        found = self._all().filter(hit).groupBy(SEGMENT).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(test, F.lit(False))).alias("bad")).collect()
        return {r[SEGMENT]: r["n"] for r in found}, any(r["bad"] for r in found)

    def _step(self, step: Callable[[DataFrame], DataFrame], counts: dict[str | None, int]) -> None:
        self.steps.append(step)
        self.hit |= {s for s in counts if s is not None}
        if self.inserted is not None:
            self.inserted = step(self.inserted)

    def update(self, hit: Column, values: dict[str, Column], counts: dict[str | None, int]) -> None:
        def step(rows: DataFrame) -> DataFrame:
            rows = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)) & ~F.col(GONE))
            new = {c: F.when(F.col("_hit"), v).otherwise(F.col(f"`{c}`")) for c, v in values.items()}
            return rows.withColumns(new | {TOUCHED: F.col(TOUCHED) | F.col("_hit")}).drop("_hit")

        self._step(step, counts)

    def delete(self, hit: Column, counts: dict[str | None, int]) -> None:
        def step(rows: DataFrame) -> DataFrame:
            rows = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)) & ~F.col(GONE))
            return rows.withColumns({TOUCHED: F.col(TOUCHED) | F.col("_hit"), GONE: F.col(GONE) | F.col("_hit")}).drop("_hit")

        self._step(step, counts)
        self.n_inserted -= counts.get(None, 0)
        self.n_gone += sum(n for s, n in counts.items() if s is not None)

    def insert(self, rows: DataFrame, count: int) -> None:
        """Rows with RIDs from next_rid on."""
        rows = rows.withColumns({SEGMENT: F.lit(None).cast("string"), TOUCHED: F.lit(False), GONE: F.lit(False)})
        self.inserted = rows if self.inserted is None else self.inserted.unionByName(rows)
        self.n_inserted += count
        self.next_rid += count


@dataclass
class Transaction:
    states: dict[str, State] = field(default_factory=dict)
    statements: list[str] = field(default_factory=list)

    def state(self, storage: Storage, db: Database, table: Table) -> State:
        return self.states.setdefault(table.name.lower(), State.of(storage, db, table))


def _hash(table: Table) -> Column:
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in table.fields))


def check(storage: Storage, db: Database, state: State) -> None:
    """Raises if a row that the transaction touched is no longer what it was at the start."""
    now, base = db.tables.get(state.base.name.lower()), state.base
    if base.same(now):
        return
    if now is None or now.uid != base.uid:
        raise SqlError(f"{base.name} was dropped by another session")
    touched = state.old().filter(TOUCHED).select(RID)
    before = storage.read(db, base).select(RID, _hash(base).alias("h0")).join(touched, RID, "left_semi")
    after = storage.read(db, now).select(RID, _hash(now).alias("h1"))
    if not before.join(after, RID, "left").filter("h1 is null or h0 <> h1").isEmpty():
        raise SqlError(f"{base.name} was changed by another session")


def publish(storage: Storage, db: Database, state: State, sorted_by: list[str] | None = None) -> Table:
    """The table as the state leaves it, its new segments written; the catalog is not saved yet."""
    now, base = db.table(state.base.name), state.base
    columns = [F.col(f"`{c}`") for c in (RID, *(f.name for f in base.fields))]
    if now.same(base):
        hit = [s for s in now.segments if s.name.rpartition("/")[2] in state.hit]
        rows = state.old(hit).filter(f"not {GONE}").select(*columns) if hit else None
        left = sum(s.rows for s in hit) - state.n_gone
    else:
        hit, rows = _over(storage, db, state, now)
        left = None
    segments = [s for s in now.segments if s not in hit]
    if rows is not None and left != 0:
        segments.append(storage.write(db, base, rows, sorted_by, left)[0])
    shift = now.next_rid - base.next_rid
    if state.n_inserted:
        fresh = state.inserted.filter(f"not {GONE}").select(*columns)
        # Rows that others inserted meanwhile keep their numbers, these move up.
        moved = fresh.withColumn(RID, F.col(RID) + shift) if shift else fresh
        segments.append(storage.write(db, base, moved, sorted_by, state.n_inserted)[0])
    segments = storage.merged(db, base, [s for s in segments if s.rows], sorted_by)
    return now.changed(segments, max(now.next_rid, state.next_rid + shift))


def _over(storage: Storage, db: Database, state: State, now: Table) -> tuple[list[Segment], DataFrame | None]:
    """The segments of a newer table that hold a row which the state touched, and their rows with its changes."""
    fields = state.base.fields
    touched = state.old().filter(TOUCHED).select(RID, GONE, F.lit(True).alias("_there"), *(F.col(f"`{f.name}`").alias(f"_new_{i}") for i, f in enumerate(fields)))
    found = storage.read(db, now, segment=True).select(RID, SEGMENT).join(touched, RID, "left_semi").select(SEGMENT).distinct().collect()
    names = {r[SEGMENT] for r in found}
    hit = [s for s in now.segments if s.name.rpartition("/")[2] in names]
    if not hit:
        return [], None
    both = storage.read(db, now, hit).join(touched, RID, "left").filter(f"not coalesce({GONE}, false)")
    return hit, both.select(RID, *(F.when(F.col("_there"), F.col(f"_new_{i}")).otherwise(F.col(f"`{f.name}`")).alias(f.name) for i, f in enumerate(fields)))
