from evalspark.sources.fixtures import Fixtures  # noqa: F401
