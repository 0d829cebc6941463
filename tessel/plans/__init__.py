"""Composed jobs (flights, orders, classifier, profiling) and their stand-in inputs."""
