"""The streaming job."""

from tidings.streaming.job import NotificationJob
from tidings.streaming.progress import BatchCounts, ProgressLog

__all__ = ["BatchCounts", "NotificationJob", "ProgressLog"]
