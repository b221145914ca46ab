"""Services that the paged reader asks in tests."""

import json


class JsonLines:
    """Over a local file of JSON lines; answers equality. Writes down what it is asked."""

    operations = ("=",)

    def __init__(self, options: dict):
        self.log = options.get("log")
        with open(options["file"], encoding="utf-8") as f:
            self.rows = [json.loads(line) for line in f]

    def note(self, asked: str) -> None:
        if self.log:
            with open(self.log, "a", encoding="utf-8") as f:
                f.write(asked + "\n")

    def where(self, filters: list[tuple]) -> None:
        for column, _, value in filters:
            self.rows = [r for r in self.rows if r[column] == value]

    def count(self) -> int:
        self.note(f"count {len(self.rows)}")
        return len(self.rows)

    def fetch(self, start: int, size: int) -> list[dict]:
        self.note(f"fetch {start}")
        return self.rows[start : start + size]


class Numbered:
    """Made-up records, as many as the option records says."""

    def __init__(self, options: dict):
        self.n = int(options.get("records", "0"))

    def count(self) -> int:
        return self.n

    def fetch(self, start: int, size: int) -> list[dict]:
        return [{"accession": f"AC{i}", "description": f"record {i}", "seq": "ACGT"[i % 4] * (i % 7)} for i in range(start, min(start + size, self.n))]
