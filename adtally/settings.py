"""Settings of one measured run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

# Defaults of the benchmark run.
TOPIC = "ad-events"
TOPIC_PARTITIONS = 200
BROKER_PORT = 9092
TRIGGER_MILLIS = 2000
WINDOW_SECONDS = 10
CAMPAIGNS = 100
ADS_PER_CAMPAIGN = 10
LOAD_RATE = 10000
REDUCED_LOAD_RATE = 1000
RUN_SECONDS = 120
PHASE_SECONDS = 40
VIEW = "view"


@dataclass(frozen=True)
class RunSettings:
    brokers: tuple[str, ...] = ("localhost",)
    broker_port: int = BROKER_PORT
    topic: str = TOPIC
    topic_partitions: int = TOPIC_PARTITIONS
    trigger_millis: int = TRIGGER_MILLIS
    window_seconds: int = WINDOW_SECONDS
    campaigns: int = CAMPAIGNS
    ads_per_campaign: int = ADS_PER_CAMPAIGN
    load_rate: float = LOAD_RATE
    reduced_load_rate: float = REDUCED_LOAD_RATE
    run_seconds: int = RUN_SECONDS
    phase_seconds: int = PHASE_SECONDS
    nodes: int = 1
    system: str = "spark"
    test: int = 1

    @property
    def window(self) -> str:
        return f"{self.window_seconds} seconds"

    @property
    def bootstrap_servers(self) -> str:
        return ",".join(f"{host}:{self.broker_port}" for host in self.brokers)

    @classmethod
    def from_mapping(cls, conf: Mapping[str, Any], **overrides: Any) -> RunSettings:
        """Settings from a run configuration already loaded into a mapping.

        Keys that do not concern the Spark job are ignored. A broker entry may
        hold several host names parted by blanks or commas.
        """
        named = {
            "kafka.port": "broker_port",
            "kafka.topic": "topic",
            "kafka.partitions": "topic_partitions",
            "spark.batchtime": "trigger_millis",
            "process.hosts": "nodes",
        }
        values: dict[str, Any] = {field: conf[key] for key, field in named.items() if key in conf}
        if "kafka.brokers" in conf:
            hosts = " ".join(conf["kafka.brokers"]).replace(",", " ").split()
            values["brokers"] = tuple(hosts)
        return cls(**{**values, **overrides})
