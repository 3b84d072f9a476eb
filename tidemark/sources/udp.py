"""A streaming source of UDP datagrams, one text line each."""

from __future__ import annotations

import json
import socket
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class UdpReader(SimpleDataSourceStreamReader):
    """Receives in the driver what waits at the socket; a batch that is asked for again is kept until it is committed.

    With the option ``spool``, a folder that outlives the driver, batches are kept there, so one that was planned before a
    restart is found after it. Datagrams that arrive while no driver listens are lost, as UDP has it.
    """

    def __init__(self, options: dict) -> None:
        self.address = options.get("host", "127.0.0.1"), int(options.get("port", "8001"))
        self.most = int(options.get("maxdatagrams", "100000"))
        self.kept: dict[int, list[str]] = {}
        self.spool = Path(options["spool"]) if "spool" in options else None
        if self.spool:
            self.spool.mkdir(parents=True, exist_ok=True)
        self.socket: socket.socket | None = None

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind(self.address)
            self.socket.settimeout(0.2)
        lines: list[str] = []
        try:
            while len(lines) < self.most:
                lines.append(self.socket.recv(1024).decode("utf-8", "replace").rstrip("\n"))
        except TimeoutError:
            pass
        if not lines:
            return iter(()), start
        self._keep(start["batch"], lines)
        return iter([(x,) for x in lines]), {"batch": start["batch"] + 1}

    def _keep(self, batch: int, lines: list[str]) -> None:
        self.kept[batch] = lines
        if self.spool:
            part = self.spool / f".{batch}"
            part.write_text(json.dumps(lines))
            part.rename(self.spool / f"{batch}.json")

    def _kept(self, batch: int) -> list[str]:
        if batch not in self.kept and self.spool and (file := self.spool / f"{batch}.json").exists():
            return json.loads(file.read_text())
        return self.kept.get(batch, [])

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(x,) for k in range(start["batch"], end["batch"]) for x in self._kept(k)])

    def commit(self, end: dict) -> None:
        for k in [k for k in self.kept if k < end["batch"]]:
            del self.kept[k]
        for file in self.spool.glob("*.json") if self.spool else ():
            if int(file.stem) < end["batch"]:
                file.unlink()


class UdpSource(DataSource):
    """``spark.dataSource.register(UdpSource)``, then ``spark.readStream.format("udp_lines")`` with host and port."""

    @classmethod
    def name(cls) -> str:
        return "udp_lines"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return UdpReader(self.options)
