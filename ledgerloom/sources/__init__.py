"""Readers and writers of the feeds: settlement and invoice CSV, camt.053 XML, MT103 text, rates, truth."""
