"""Readers that turn raw strings (CSV, HTML, JSON, wikitext) into typed relations, and writers that append, replace and log."""
