"""fitlake: membership analytics (members, trainers, sessions, workouts,
health metrics, notifications) as set-based Spark DataFrame operators.

Entry points: `fitlake.plans.registry.queries()` (every operator as a
registered query), `fitlake.sources.tables` (sources and sinks),
`fitlake.operators.*` (the operators), `fitlake.streaming.twins`.
"""

__version__ = "0.1.0"
