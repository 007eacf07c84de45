"""Training-data operators: packing, tokenising, licence scans, archives, personal data, media, quality, toxicity and near duplicates.

Nothing outside this folder imports it; ``registry`` holds its queries and their SQL.
"""
