"""Sequenced changes applied by a stateful stream whose clock ticks are aimed by the state reader.

Changes of a client carry numbers and are applied in the order of these; a change that comes before its
predecessors is held in state. Batches of changes are appended to a feed, and for each the streaming query is
started anew on one checkpoint. Before a start the ``statestore`` source reads the heads of all clients from the
checkpoint; those whose earliest held change has waited too long get a clock row in the feed, and no other
client without changes is touched. The processor lets the number of such a client jump to its held changes.

Within a batch the order of rows doesn't matter: of several rows of one number the first by (day, change_id)
counts, and a number is passed over at the start of a batch only. So rows are taken as they come, none is
sorted or gathered. About ``GROUP`` clients share a key of state, whose value holds their heads and what few changes
wait; more than ``FEW`` waiting changes of a client stand apart, in blocks of ``BLOCK`` numbers of which
at most ``MOST_BLOCKS`` are in memory. Ranks are taken in ranges (``running_total``), so that a client may hold any
share of the rows.

Defined results: repeated rows count once; a null client is a client of its own; a null ``seq`` ranks
first; rows without a ``valid_at`` or a ``change_id`` have no day and vanish; a null or unknown ``op`` is applied and changes
nothing; days before the first batch belong to it; an empty table gives no rows; columns beside those named take part
in telling repeated rows apart, and are ignored otherwise. Changes of one client are applied one by one, which no split of its key
can change; their number in one task is bounded by the client's share of a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.folds import running_total
from ._util import materialize, shared_dir, table

#: A held change waits until a day this much later has been seen in an earlier batch.
WAIT = 3
BLOCK, MOST_BLOCKS = 512, 64
#: So many waiting changes of a client stay with its head, and so many clients share a group on average.
FEW, GROUP = 64, 128
#: A store of state (one to a task) is opened anew at each start, so there are as many as keep all cores busy, or one
#: for so many changes, whatever number of partitions the session's other shuffles have.
STORE_ROWS = 50_000
#: Later than all days: what still waits after the last batch is applied.
END = 2**30

_CHANGE = "n bigint, day int, change_id bigint, op string, city string, balance double, batch int"
FED = f"grp bigint, client_id bigint, {_CHANGE}, horizon int"
#: Of all clients of a group, then of all their changes that wait and aren't stored apart.
_HEAD = "client_id bigint, next bigint, city string, balance double, held bigint, earliest int, stored boolean"
HEADS = ", ".join(f"{name} array<{kind}>" for name, kind in (x.split() for x in f"{_HEAD}, of int, {_CHANGE.replace('city', 'new_city').replace('balance', 'new_balance')}".split(", ")))
APPLIED = "change_id bigint, client_id bigint, n bigint, op string, status string, batch int, missed bigint, city string, balance double"

_APPLIED_ROW = Row(*[c.split()[0] for c in APPLIED.split(", ")])

#: Many small stores: none sets space aside, and each is closed when its task ends.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


class Held:
    """The waiting changes of one client: number -> (n, day, change_id, op, city, balance, batch), in blocks. Few of them stay
    with the client's head; blocks that are too many for memory are ``stored`` in the map state ``states``."""

    def __init__(self, states, client: int | None, sizes: tuple[int, int, int], stored: bool = False):
        self.states, self.client, self.stored = states, client, stored
        self.few, self.size, self.most = sizes
        self.open: dict[int, dict[int, tuple]] = {}

    def block(self, of: int) -> dict[int, tuple]:
        at = of // self.size
        if at not in self.open:
            if len(self.open) >= self.most:
                self.flush()
            kept = self.states.getValue((self.client, at)) if self.stored else None
            self.open[at] = {r[0]: tuple(r) for r in kept[0]} if kept else {}
        return self.open[at]

    def flush(self) -> None:
        for at, rows in self.open.items():
            if rows:
                self.states.updateValue((self.client, at), ([*rows.values()],))
            elif self.stored and self.states.containsKey((self.client, at)):
                self.states.removeKey((self.client, at))
        self.stored |= any(self.open.values())
        self.open = {}

    def blocks(self) -> Iterator[dict[int, tuple]]:
        """All blocks, by number."""
        at = {k[1] for k in self.states.keys() if k[0] == self.client} if self.stored else set()
        for k in sorted(at | set(self.open)):
            yield self.block(k * self.size)

    def inline(self, count: int) -> list[tuple]:
        """What is kept with the head: all of ``count`` changes if they are few and none is stored."""
        if self.stored or count > self.few:
            self.flush()
            self.stored = count > 0
            return []
        return [r for b in self.open.values() for r in b.values()]


class Client:
    """Head of a client: its next number, values, and what waits."""

    def __init__(self, of: int | None, states, sizes: tuple[int, int, int], number: int = 1, city: str | None = None, balance: float | None = None, count: int = 0, earliest: int | None = None, stored: bool = False):
        self.of, self.number, self.city, self.balance, self.count, self.earliest = of, number, city, balance, count, earliest
        self.held = Held(states, of, sizes, stored)
        self.seen = False

    def _apply(self, change: tuple, batch: int, missed: int) -> Row:
        n, _, change_id, op, city, balance, _ = change
        if op == "I":
            self.city, self.balance = city, balance
        elif op == "U":
            self.city, self.balance = self.city if city is None else city, self.balance if balance is None else balance
        elif op == "D":
            self.city = self.balance = None
        self.number, self.count = n + 1, self.count - 1
        return _APPLIED_ROW(change_id, self.of, n, op, "applied", batch, missed, self.city, self.balance)

    def run(self, batch: int) -> Iterator[Row]:
        """Apply held changes while the next number is among them."""
        before = self.count
        while self.count and (change := self.held.block(self.number).pop(self.number, None)):
            yield self._apply(change, batch, 0)
        if self.count < before:
            self._look()

    def _look(self) -> None:
        self.earliest = min((r[1] for b in self.held.blocks() for r in b.values()), default=None) if self.count else None

    def expire(self, batch: int, horizon: int | None) -> Iterator[Row]:
        """At the start of a batch: jump from one held number to the next until the last expired one is applied."""
        if self.earliest is None or horizon is None or self.earliest + WAIT > horizon:
            return
        last = max(n for b in self.held.blocks() for n, r in b.items() if r[1] + WAIT <= horizon)
        for b in self.held.blocks():
            for n in sorted(x for x in b if x <= last):
                yield self._apply(b.pop(n), batch, n - self.number)
            if self.number > last:
                break
        yield from self.run(batch)
        self._look()

    def take(self, change: tuple) -> tuple | None:
        """Hold ``change``; returns the change that is rejected, if any."""
        n, day, change_id, _, _, _, batch = change
        if n < self.number:
            return change
        block = self.held.block(n)
        old = block.get(n)
        if old and (old[6] != batch or old[1:3] <= (day, change_id)):
            return change
        block[n] = change
        self.count += old is None
        self.earliest = day if self.earliest is None else min(self.earliest, day)
        return old


class Applier(StatefulProcessor):
    """Holds, applies and rejects changes of a group of clients, whose heads are one value of state, so that a group costs
    few calls of the state server. Any row tells its batch and that batch's horizon (the largest day of earlier batches); a
    clock row has no number. ``sizes``: waiting changes kept with a head, numbers of a block, blocks of a client in memory."""

    def __init__(self, sizes: tuple[int, int, int]):
        self.sizes = sizes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getValueState("heads", HEADS)
        self.blocks = handle.getMapState("held", "client_id bigint, block bigint", f"changes array<struct<{', '.join(x.replace(' ', ':', 1) for x in _CHANGE.split(', '))}>>")

    def _load(self) -> dict[int | None, Client]:
        state = self.heads.get()
        if not state:
            return {}
        clients = [Client(of, self.blocks, self.sizes, *head) for of, *head in zip(*state[:7], strict=True)]
        for at, *change in zip(*state[7:], strict=True):
            clients[at].held.block(change[0])[change[0]] = tuple(change)
        return {c.of: c for c in clients}

    def _save(self, clients: list[Client]) -> None:
        waiting = [(at, *change) for at, c in enumerate(clients) for change in c.held.inline(c.count)]
        heads = [(c.of, c.number, c.city, c.balance, c.count, c.earliest, c.held.stored) for c in clients]
        self.heads.update((*map(list, zip(*heads, strict=True)), *(map(list, zip(*waiting, strict=True)) if waiting else [[]] * 8)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802,N803
        clients = self._load()
        batch = None
        for row in rows:
            batch = row.batch
            client = clients.get(row.client_id)
            if client is None:
                client = clients[row.client_id] = Client(row.client_id, self.blocks, self.sizes)
            if not client.seen:
                client.seen = True
                yield from client.expire(batch, row.horizon)
            if row.n is None:
                continue
            late = client.take((row.n, row.day, row.change_id, row.op, row.city, row.balance, batch))
            if late:
                yield _APPLIED_ROW(late[2], client.of, late[0], late[3], "rejected", batch, 0, None, None)
        for client in clients.values():
            if client.seen:
                yield from client.run(batch)
        self._save([*clients.values()])

    def close(self) -> None:
        pass


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session that hold for a while."""
    own = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def expired(spark: SparkSession, checkpoint: str, horizon: int) -> DataFrame:
    """(client_id) of the clients whose earliest held change has expired, read from the checkpoint."""
    groups = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "heads").load()
    heads = groups.select(F.explode(F.arrays_zip("value.client_id", "value.earliest")).alias("head"))
    return heads.where(F.col("head.earliest") + WAIT <= horizon).select(F.col("head.client_id").alias("client_id"))


class Feed:
    """A feed of changes and the stream that follows it, below ``path``. ``groups``: how many groups share the clients;
    ``n_rows``: about how many changes all batches hold."""

    def __init__(self, spark: SparkSession, path: str, groups: int, n_rows: int = 0):
        self.spark, self.path, self.groups, self.checkpoint = spark, path, groups, f"{path}/checkpoint"
        self.stores = min(groups, max(2 * spark.sparkContext.defaultParallelism, -(-n_rows // STORE_ROWS)))
        self.started = False

    def tick(self, changes: DataFrame, batch: int, horizon: int | None) -> None:
        """Append the batch's changes and the clock rows that are due, and start the stream on them."""
        rows = changes.select("client_id", "n", "day", "change_id", "op", "city", "balance")
        if self.started and horizon is not None:
            rows = rows.unionByName(expired(self.spark, self.checkpoint, horizon), allowMissingColumns=True)
        rows = rows.withColumn("batch", F.lit(batch)).withColumn("horizon", F.lit(horizon).cast("int")).withColumn("grp", F.pmod(F.xxhash64("client_id"), F.lit(self.groups)))
        with _settings(self.spark, _SETTINGS | {"spark.sql.shuffle.partitions": str(self.stores)}):
            rows.write.mode("append").parquet(f"{self.path}/feed")
            fed = self.spark.readStream.schema(FED).parquet(f"{self.path}/feed")
            done = fed.groupBy("grp").transformWithState(Applier((FEW, BLOCK, MOST_BLOCKS)), APPLIED, "append", "none")
            query = done.writeStream.format("parquet").option("path", f"{self.path}/applied").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
        self.started = True

    def read(self) -> DataFrame:
        return self.spark.read.schema(APPLIED).parquet(f"{self.path}/applied")


def apply_changes(changes: DataFrame, batches: int) -> DataFrame:
    """The fate of every change: columns of ``APPLIED`` and ``current``. ``changes`` has client_id, the columns of a change,
    and ``batch`` from 1 to ``batches``; it is read once for each batch, so it should be a table partitioned by it."""
    spark = changes.sparkSession
    clients, n_rows = changes.agg(F.approx_count_distinct("client_id"), F.count("*")).first()
    feed = Feed(spark, f"{shared_dir(spark)}/cairn/{uuid.uuid4().hex}/sequenced", 1 + clients // GROUP, n_rows)
    # as many rows as batches
    days = {r["batch"]: r["day"] for r in changes.groupBy("batch").agg(F.max("day").alias("day")).collect()}
    for batch in range(1, batches + 1):
        feed.tick(changes.where(F.col("batch") == batch), batch, max((d for b, d in days.items() if b < batch), default=None))
    feed.tick(changes.where("false"), batches + 1, END)
    done = feed.read()
    last = done.where("status = 'applied'").groupBy(F.col("client_id").alias("of")).agg(F.max("n").alias("last"))
    final = (F.col("status") == "applied") & F.col("last").isNotNull() & ~F.col("op").eqNullSafe("D")
    return done.join(last, F.col("client_id").eqNullSafe(F.col("of")) & (F.col("n") == F.col("last")), "left").select(*done.columns, final.alias("current"))


def in_batches(raw: DataFrame, batches: int = 12, first_day: int = 19723, days: int = 160, late: int = 9, lost: int = 11) -> DataFrame:
    """Changes with their dense rank ``n``, arrival ``day`` and ``batch``, as a table partitioned by batch. A change arrives up
    to three times ``late`` days after it was made; one in ``lost`` never does."""
    own = materialize(raw.distinct().select("change_id", "client_id", "seq", "op", "valid_at", "city", "balance"), "changes")
    ranks = running_total(own.select("client_id", "seq").distinct(), ["client_id"], ["seq"], F.lit(1)).select(F.col("client_id").alias("of"), F.col("seq").alias("place"), (F.col("before") + 1).cast("bigint").alias("n"))
    h = F.crc32(F.col("change_id").cast("string"))
    day = (F.unix_date(F.to_date("valid_at")) + late * (h % 4)).cast("int")
    came = own.withColumn("day", day).where(F.col("day").isNotNull() & (h % lost != 0))
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("day") - first_day) * batches / days))).cast("int")
    ranked = came.join(ranks, F.col("client_id").eqNullSafe(F.col("of")) & F.col("seq").eqNullSafe(F.col("place")))
    placed = ranked.select("client_id", "n", "day", "change_id", "op", "city", "balance", batch.alias("batch")).repartitionByRange("batch", "change_id")
    spark = raw.sparkSession
    path = f"{shared_dir(spark)}/cairn/{uuid.uuid4().hex}/batches"
    placed.write.partitionBy("batch").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def op13_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = apply_changes(in_batches(table(spark, sf_dir, "client_changes")), 12)
    return done.select("change_id", "client_id", "status", "batch", "missed", "city", F.floor(100 * F.col("balance") + 0.5).cast("bigint").alias("cents"), "current")
