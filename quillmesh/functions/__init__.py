"""quillmesh.functions"""
