"""All queries of the library by name, and their DuckDB SQL."""

from __future__ import annotations

from sievewell.plans import governance, judged, manifests, measures, outputs, screen, streams

QUERIES = screen.QUERIES | measures.QUERIES | governance.QUERIES | streams.QUERIES | judged.QUERIES | manifests.QUERIES | outputs.QUERIES
ORACLES = screen.ORACLES | measures.ORACLES | governance.ORACLES | streams.ORACLES | judged.ORACLES | manifests.ORACLES | outputs.ORACLES
