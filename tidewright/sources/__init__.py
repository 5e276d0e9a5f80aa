"""Inputs: files and their manifests, and readers of each format."""

from .files import RemoteFile, SourceManifest, discover, list_objects, publish_file_atomic

__all__ = ["RemoteFile", "SourceManifest", "discover", "list_objects", "publish_file_atomic"]
