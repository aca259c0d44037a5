"""Progress in the log."""

import logging

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


class BatchCounts(dict[int, int]):
    """Notifications by batch, for any number of listeners to read; only the last ``keep`` batches are held."""

    def __init__(self, keep: int = 1000):
        super().__init__()
        self.keep = keep

    def __setitem__(self, batch_id: int, sent: int) -> None:
        self.pop(batch_id, None)
        super().__setitem__(batch_id, sent)
        while len(self) > self.keep:
            del self[next(iter(self))]


class ProgressLog(StreamingQueryListener):
    """Log rows in, notifications out and duration of each micro-batch."""

    def __init__(self, sent: BatchCounts):
        self._sent = sent

    def onQueryStarted(self, event) -> None:
        log.info("query %s started, id %s", event.name, event.id)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        counted = progress.observedMetrics.get("campaigns")
        log.info(
            "query %s, batch %d: %d rows in (%s), %s notifications out, %d ms",
            progress.name,
            progress.batchId,
            progress.numInputRows,
            counted.asDict() if counted else "not counted",
            self._sent.get(progress.batchId, "unknown"),
            progress.durationMs.get("triggerExecution", 0),
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.info("query %s ended%s", event.id, f": {event.exception}" if event.exception else "")
