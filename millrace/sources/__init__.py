"""Readers and writers for the text, XML and binary inputs."""
