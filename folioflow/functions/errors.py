"""Errors with the codes that callers are told."""

from __future__ import annotations


class EngineError(Exception):
    code = "INTERNAL_ERROR"


class ValidationError(EngineError):
    code = "VALIDATION_ERROR"


class RegistryError(EngineError):
    code = "REGISTRY_ERROR"


class ContentError(EngineError):
    code = "CONTENT_ERROR"


class PrerequisiteError(EngineError):
    code = "PREREQUISITE_ERROR"


def describe(error: Exception) -> dict[str, str]:
    return {"error": str(error), "code": getattr(error, "code", "INTERNAL_ERROR")}
