"""Readers, writers and the adapters that view the test tables as evaluation inputs."""
