"""Flow control and counters around streams."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class Gate:
    """Holds back a producer: closed when more than most are in flight, open again under half of that."""

    def __init__(self, most: int):
        if most < 1:
            raise ValueError("most must be at least 1")
        self.most, self.in_flight, self.open = most, 0, True

    def sent(self, n: int = 1) -> bool:
        self.in_flight += n
        if self.in_flight > self.most:
            self.open = False
        return self.open

    def done(self, n: int = 1) -> bool:
        self.in_flight = max(0, self.in_flight - n)
        if self.in_flight * 2 < self.most:
            self.open = True
        return self.open


class Counters(StreamingQueryListener):
    """Rows, batches and mean time of a batch since the last reading."""

    def __init__(self):
        self.rows = self.batches = self.ms = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.rows += p.numInputRows
        self.batches += 1
        self.ms += p.batchDuration

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def read(self) -> dict:
        out = {"rows": self.rows, "batches": self.batches, "ms_per_batch": self.ms / self.batches if self.batches else 0.0}
        self.rows = self.batches = self.ms = 0
        return out
