"""chatlake.operators"""
