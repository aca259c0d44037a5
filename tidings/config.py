"""Settings, read from the environment so that no secret is in the code."""

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# Security settings of the message broker.
SECURITY_PROTOCOL = "SASL_SSL"
SASL_MECHANISM = "SCRAM-SHA-512"
LOGIN_MODULE = "org.apache.kafka.common.security.scram.ScramLoginModule"
JDBC_DRIVER = "org.postgresql.Driver"


@dataclass(frozen=True)
class KafkaConfig:
    """One topic and how to reach it."""

    servers: str
    topic: str
    username: str = ""
    password: str = field(default="", repr=False)
    starting_offsets: str = "latest"
    max_offsets_per_trigger: int | None = None
    max_records_per_partition: int | None = None

    def connection(self) -> dict[str, str]:
        options = {"kafka.bootstrap.servers": self.servers}
        if self.username:
            options["kafka.security.protocol"] = SECURITY_PROTOCOL
            options["kafka.sasl.mechanism"] = SASL_MECHANISM
            options["kafka.sasl.jaas.config"] = (
                f"{LOGIN_MODULE} required "
                f'username="{_quoted(self.username)}" password="{_quoted(self.password)}";'
            )
        return options


@dataclass(frozen=True)
class JdbcConfig:
    """One table and how to reach it."""

    url: str
    table: str
    user: str = ""
    password: str = field(default="", repr=False)
    driver: str = JDBC_DRIVER
    # Connections to open at once, and rows per round trip.
    partitions: int = 8
    batch_rows: int = 10_000

    def connection(self) -> dict[str, str]:
        options = {"url": self.url, "driver": self.driver}
        if self.user:
            options |= {"user": self.user, "password": self.password}
        return options


@dataclass(frozen=True)
class JobConfig:
    """Everything the streaming job needs."""

    campaigns: KafkaConfig
    messages: KafkaConfig
    favourites: JdbcConfig
    feedback: JdbcConfig
    checkpoint: str
    dead_letters: str
    name: str = "campaign_notifications"
    trigger_seconds: int = 0
    backfill: bool = False
    once: bool = True
    tap: bool = False

    def trigger(self) -> dict | None:
        """For ``writeStream.trigger``: all there is and stop, a pace, or Spark's default."""
        if self.backfill:
            return {"availableNow": True}
        if self.trigger_seconds:
            return {"processingTime": f"{self.trigger_seconds} seconds"}
        return None

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> "JobConfig":
        def get(name: str, default: str | None = None) -> str:
            value = env.get(f"TIDINGS_{name}", default)
            if value is None:
                raise KeyError(f"TIDINGS_{name} is not set")
            return value

        def limit(name: str) -> int | None:
            value = get(name, "")
            return int(value) if value else None

        backfill = get("BACKFILL", "") == "1"

        def topic(name: str) -> KafkaConfig:
            return KafkaConfig(
                servers=get("KAFKA_SERVERS"),
                topic=get(name),
                username=get("KAFKA_USERNAME", ""),
                password=get("KAFKA_PASSWORD", ""),
                starting_offsets=get("STARTING_OFFSETS", "earliest" if backfill else "latest"),
                max_offsets_per_trigger=limit("MAX_OFFSETS_PER_TRIGGER"),
                max_records_per_partition=limit("MAX_RECORDS_PER_PARTITION"),
            )

        def table(prefix: str, default: str) -> JdbcConfig:
            return JdbcConfig(
                url=get(f"{prefix}_URL"),
                table=get(f"{prefix}_TABLE", default),
                user=get(f"{prefix}_USER", ""),
                password=get(f"{prefix}_PASSWORD", ""),
                driver=get(f"{prefix}_DRIVER", JDBC_DRIVER),
                partitions=int(get(f"{prefix}_PARTITIONS", "8")),
            )

        return cls(
            campaigns=topic("TOPIC_IN"),
            messages=topic("TOPIC_OUT"),
            favourites=table("FAVOURITES", "subscribers_restaurants"),
            feedback=table("FEEDBACK", "subscribers_feedback"),
            checkpoint=get("CHECKPOINT"),
            dead_letters=get("DEAD_LETTERS"),
            trigger_seconds=int(get("TRIGGER_SECONDS", "0")),
            backfill=backfill,
            once=get("ONCE", "1") == "1",
            tap=get("TAP", "") == "1",
        )


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"')
