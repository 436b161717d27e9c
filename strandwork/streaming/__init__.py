"""Repositories that follow a folder as files arrive."""
