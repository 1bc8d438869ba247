"""Web API and search-index readers as Spark data sources, and the shaping of what they return.

A reader's partitions are page ranges or index slices, so pages are fetched by the executors and
never pass through the driver. `transport` is the one part that touches the network: a function
from a request to a decoded JSON body, which tests replace by captured pages.
"""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Transport = Callable[[str, Mapping[str, str], dict | None], dict | list]


def http_json(url: str, headers: Mapping[str, str], body: dict | None = None) -> Reply:
    data = json.dumps(body).encode() if body is not None else None
    request = urllib.request.Request(url, data=data, headers={"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=60) as response:
        return Reply(json.load(response), dict(response.headers))


class _Slice(InputPartition):
    def __init__(self, number: int):
        self.number = number


class Reply(NamedTuple):
    """What a transport may return instead of the body alone."""

    body: dict | list
    headers: Mapping[str, str]


PAGINATORS = ("single", "page_number", "offset", "json_link", "header_link", "cursor")
NEXT_LINK = re.compile(r"""<([^>]*)>[^,]*;\s*rel="?next"?""", re.I)


def _reply(answer) -> Reply:
    return answer if isinstance(answer, Reply) else Reply(answer, {})


def _next_link(headers: Mapping[str, str]) -> str | None:
    listed = next((v for k, v in headers.items() if k.lower() == "link"), "")
    found = NEXT_LINK.search(listed)
    return found[1] if found else None


def _at(body: Mapping, path: str):
    for part in path.split("."):
        body = body.get(part) if isinstance(body, Mapping) else None
    return body


def _records(body: dict | list, path: str | None) -> list:
    """The list of records in a response: under `path`, the body itself, or its only list."""
    if path:
        for part in path.split("."):
            body = body[part]
        return body
    if isinstance(body, list):
        return body
    lists = [v for v in body.values() if isinstance(v, list)]
    return lists[0] if len(lists) == 1 else [body]


def _listed(body: dict | list, path: str | None) -> list:
    """The records of a numbered page, which must be a list: only an empty one tells where the pages end."""
    if not path and isinstance(body, dict):
        lists = sorted(k for k, v in body.items() if isinstance(v, list))
        if len(lists) != 1:
            raise ValueError(f"a numbered page holds {len(lists)} lists {lists}: name the one to read in the option 'records'")
    found = _records(body, path)
    if not isinstance(found, list):
        raise ValueError(f"{path!r} is no list in a numbered page")
    return found


class RestReader(DataSourceReader):
    """Pages of one endpoint. `page_number` splits pages over tasks; links, cursors and offsets are followed in one task."""

    def __init__(self, options: Mapping[str, str], transport: Transport):
        self.options, self.transport = dict(options), transport
        self.paginator = self.options.get("paginator", "single")
        if self.paginator not in PAGINATORS:
            raise ValueError(f"unknown paginator {self.paginator!r}")
        self.slices = int(self.options.get("slices", "1")) if self.paginator == "page_number" else 1

    def partitions(self):
        return [_Slice(i) for i in range(self.slices)]

    def _get(self, url: str):
        token = self.options.get("token")
        return self.transport(url, {"Authorization": f"Bearer {token}"} if token else {}, None)

    def _url(self, **extra) -> str:
        base = self.options["base_url"].rstrip("/") + "/" + self.options["endpoint"].lstrip("/")
        return base + ("?" + urllib.parse.urlencode(extra) if extra else "")

    def read(self, partition: _Slice) -> Iterator[tuple]:
        path = self.options.get("records")
        if self.paginator in ("page_number", "offset"):
            bodies = self._numbered(partition.number, path)
        else:
            bodies = (body for _, body in self.linked(self._url()))
        for body in bodies:
            for record in _records(body, path):
                yield (json.dumps(record, ensure_ascii=False),)

    def _numbered(self, number: int, path: str | None) -> Iterator:
        """Pages until an empty one: a server may return fewer records than were asked for. An offset advances by what came."""
        size, first = int(self.options.get("page_size", "100")), int(self.options.get("first_page", "1"))
        offset, page, before = 0, first + number, None
        while True:
            body = self._page(page, size) if self.paginator == "page_number" else self._from(offset, size)
            received = len(_listed(body, path))
            # A server that knows no pages answers alike for ever.
            if not received or body == before:
                return
            before = body
            yield body
            offset, page = offset + received, page + self.slices

    def _page(self, page: int, size: int) -> dict | list:
        return _reply(self._get(self._url(page=page, per_page=size))).body

    def _from(self, offset: int, size: int) -> dict | list:
        return _reply(self._get(self._url(offset=offset, limit=size))).body

    def linked(self, url: str) -> Iterator[tuple[str, dict | list]]:
        """Pages from `url` on that name the next one: by a link in the body, a Link header, or a cursor to ask with."""
        seen = set()
        while url and url not in seen:
            seen.add(url)
            reply, asked = _reply(self._get(url)), url
            yield asked, reply.body
            url = None
            if self.paginator == "header_link":
                url = _next_link(reply.headers)
            elif isinstance(reply.body, dict) and self.paginator == "json_link":
                url = _at(reply.body, self.options.get("next", "next"))
            elif isinstance(reply.body, dict) and self.paginator == "cursor":
                cursor = _at(reply.body, self.options.get("cursor", "next_cursor"))
                url = self._url(**{self.options.get("cursor_param", "cursor"): cursor}) if cursor else None


class SearchReader(DataSourceReader):
    """Every document of an index: each task scrolls through its own slice."""

    def __init__(self, options: Mapping[str, str], transport: Transport):
        self.options, self.transport = dict(options), transport
        self.slices = int(self.options.get("slices", "1"))

    def partitions(self):
        return [_Slice(i) for i in range(self.slices)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        host, index = self.options["host"].rstrip("/"), self.options["index"]
        headers = {"Authorization": self.options["authorization"]} if "authorization" in self.options else {}
        query = {"size": int(self.options.get("page_size", "1000")), "query": {"match_all": {}}, "sort": ["_doc"]}
        if self.slices > 1:
            query["slice"] = {"id": partition.number, "max": self.slices}
        body = _reply(self.transport(f"{host}/{index}/_search?scroll=5m", headers, query)).body
        while body["hits"]["hits"]:
            for hit in body["hits"]["hits"]:
                yield (json.dumps({**hit["_source"], "_id": hit["_id"]}, ensure_ascii=False),)
            body = _reply(self.transport(f"{host}/_search/scroll", headers, {"scroll": "5m", "scroll_id": body["_scroll_id"]})).body


class _Range(InputPartition):
    """Places to read, from one up to another; what they are depends on the paginator."""

    def __init__(self, start: dict, end: dict):
        self.start, self.end = start, end


class RestStream(DataSourceStreamReader):
    """An endpoint that grows at its end, as a stream: a micro-batch holds the records that came since the last one.

    An offset is a place between two records: a page (its number or its address) and how many of its records were read,
    or a record number. Between two offsets always the same records are read, and a page that was read is not asked for
    again, but for the last one, which may have grown. Numbered pages and offsets are fetched by `slices` tasks; the
    driver only looks for the end, with a number of requests that grows with the logarithm of what is new. Links and
    cursors can only be followed: the driver follows the new ones, holding one page at a time, and one task fetches them.
    """

    def __init__(self, options: Mapping[str, str], transport: Transport):
        self.pages = RestReader(options, transport)
        self.records, self.size = options.get("records"), int(options.get("page_size", "100"))
        self.slices = int(options.get("slices", "1"))
        self.reached = self.initialOffset()

    def initialOffset(self) -> dict:
        if self.pages.paginator == "page_number":
            return {"page": int(self.pages.options.get("first_page", "1")), "taken": 0}
        return {"offset": 0} if self.pages.paginator == "offset" else {"url": self.pages._url(), "taken": 0}

    def latestOffset(self) -> dict:
        if self.pages.paginator == "page_number":
            first = self.pages._page(self.reached["page"], self.size)
            last, taken = self._last(self.reached["page"], first, self.pages._page, 1)
            found = {"page": last, "taken": taken}
        elif self.pages.paginator == "offset":
            start = self.reached["offset"]
            first = self.pages._from(start, self.size)
            last, taken = self._last(start, first, self.pages._from, max(1, len(_listed(first, self.records))))
            return {"offset": max(start, last + taken)}
        else:
            for url, body in self.pages.linked(self.reached["url"]):
                found = {"url": url, "taken": len(_records(body, self.records))}
        # A page that became shorter holds nothing new.
        here = "page" if "page" in found else "url"
        return self.reached if found[here] == self.reached[here] and found["taken"] < self.reached["taken"] else found

    def _last(self, start: int, first: dict | list, ask: Callable, step: int) -> tuple[int, int]:
        """The last place with records from `start` on, and how many a request for it gets: steps double, then halve."""
        held = {start: len(_listed(first, self.records))}

        def has(place: int) -> bool:
            if place not in held:
                body = ask(place, self.size)
                # A server that knows no pages answers alike for ever.
                held[place] = 0 if body == first else len(_listed(body, self.records))
            return held[place] > 0

        last = start
        while held[start] and has(last + step):
            last, step = last + step, step * 2
        end = last + step
        while held[start] and end - last > 1:
            middle = (last + end) // 2
            last, end = (middle, end) if has(middle) else (last, middle)
        return last, held[last]

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        # Also called with the last offset of the checkpoint when a stream starts again.
        self.reached = end
        if start == end:
            return []
        if "url" in start:
            return [_Range(start, end)]
        low, high = (start["page"], end["page"] + 1) if "page" in start else (start["offset"], end["offset"])
        cuts = sorted({low + (high - low) * i // self.slices for i in range(self.slices + 1)})
        if "offset" in start:
            return [_Range({"offset": a}, {"offset": b}) for a, b in zip(cuts, cuts[1:])]
        return [
            _Range({"page": a, "taken": start["taken"] if a == low else 0}, end if b == high else {"page": b - 1, "taken": None})
            for a, b in zip(cuts, cuts[1:])
        ]

    def read(self, partition: _Range) -> Iterator[tuple]:
        start, end = partition.start, partition.end
        if "offset" in start:
            pages = self._ranged(start["offset"], end["offset"])
        elif "page" in start:
            numbered = ((p, _listed(self.pages._page(p, self.size), self.records)) for p in range(start["page"], end["page"] + 1))
            pages = self._between(numbered, start, end, "page")
        else:
            linked = ((url, _records(body, self.records)) for url, body in self.pages.linked(start["url"]))
            pages = self._between(linked, start, end, "url")
        for found in pages:
            for record in found:
                yield (json.dumps(record, ensure_ascii=False),)

    def _between(self, pages: Iterator[tuple], start: dict, end: dict, here: str) -> Iterator[list]:
        for place, found in pages:
            last = place == end[here]
            if last and end["taken"] is not None and len(found) < end["taken"]:
                raise ValueError(f"{here} {place} has {len(found)} records, {end['taken']} were seen before")
            yield found[start["taken"] if place == start[here] else 0 : end["taken"] if last else None]
            if last:
                return
        raise ValueError(f"the pages end before {here} {end[here]}, which was seen before")

    def _ranged(self, offset: int, end: int) -> Iterator[list]:
        while offset < end:
            found = _listed(self.pages._from(offset, min(self.size, end - offset)), self.records)[: end - offset]
            if not found:
                raise ValueError(f"there is no record {offset}, {end} were seen before")
            yield found
            offset += len(found)

    def commit(self, end: dict) -> None:
        pass


def _source(short_name: str, reader: type, transport: Transport, stream: type | None = None) -> type[DataSource]:
    class WebSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> str:
            return "record string"

        def reader(self, schema):
            return reader(self.options, transport)

        def streamReader(self, schema):
            if stream is None:
                raise NotImplementedError(f"{short_name} is no stream source")
            return stream(self.options, transport)

    return WebSource


def read_rest(spark: SparkSession, schema: str, transport: Transport = http_json, **options: str) -> DataFrame:
    """Records of one endpoint in the declared columns."""
    spark.dataSource.register(_source("sluiceway_rest", RestReader, transport))
    return records_as(spark.read.format("sluiceway_rest").options(**options).load(), schema)


def stream_rest(spark: SparkSession, schema: str, transport: Transport = http_json, **options: str) -> DataFrame:
    """Records of an endpoint that grows, in the declared columns, as a stream."""
    spark.dataSource.register(_source("sluiceway_rest", RestReader, transport, RestStream))
    return records_as(spark.readStream.format("sluiceway_rest").options(**options).load(), schema)


def read_index(spark: SparkSession, schema: str, transport: Transport = http_json, **options: str) -> DataFrame:
    """Documents of one index in the declared columns, with their `_id`."""
    spark.dataSource.register(_source("sluiceway_search", SearchReader, transport))
    return records_as(spark.read.format("sluiceway_search").options(**options).load(), schema)


def records_as(records: DataFrame, schema: str, column: str = "record") -> DataFrame:
    """JSON text as declared columns; a record that does not fit the columns raises."""
    parsed = F.from_json(F.col(column), schema, {"mode": "FAILFAST"})
    return records.select(parsed.alias("_r")).select("_r.*")


def hits_table(hits: DataFrame, schema: str, column: str = "hit") -> DataFrame:
    """Captured index hits (`{"_id": ..., "_source": {...}}` as JSON text) as declared columns and `_id`."""
    parsed = F.from_json(F.col(column), f"_id string, _source struct<{schema}>", {"mode": "FAILFAST"})
    return hits.select(parsed.alias("_h")).select("_h._source.*", "_h._id")
